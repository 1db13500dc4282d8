"""Attributes of an entity as they held, and were known, at the time of an event.

Each attribute keeps its own change history ``(key, valid_from, known_at, value)``; histories are
matched separately and only then pivoted back beside the event, so no wide version table is built
and attributes may change at different times. A match is the history row with the greatest
``valid_from <= event time`` among the rows with ``known_at <= decision time`` (ties: greatest
``known_at``, then greatest value text), hence nothing that became known later is ever used.

Histories and events of a key meet in one sorted partition. Keys with many events
are salted by their number and their compressed histories go to each
salt. In a partition the search doubles links to sooner-known rows, so a long run of late
corrections costs a logarithm, not a scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netledger.operators.skew import heavy_hitters

CHUNK_ROWS = 200_000
#: Events of one key that one task takes; a key of more, and of ``HOT_SHARE`` of all, is salted.
HOT_EVENTS = 250_000
HOT_SHARE = 0.002


def change_history(df: DataFrame, key: str, valid_from, known_at, value: str, attribute: str) -> DataFrame:
    """History of one attribute as ``(key, attribute, valid_us, known_us, value, present)``.

    A row is dropped when the row before it (by valid time, then known time) has the same value
    and was known no later: whoever sees the dropped row also sees that one. Null values are
    values. Rows with a null key or time are no versions.
    """
    rows = df.select(
        F.col(key).cast("string").alias("key"),
        F.lit(attribute).alias("attribute"),
        valid_from.alias("valid_us"),
        known_at.alias("known_us"),
        F.col(value).cast("string").alias("value"),
    ).where(F.col("key").isNotNull() & F.col("valid_us").isNotNull() & F.col("known_us").isNotNull())
    # equal times: the greatest value stands, so the result doesn't depend on row order
    rows = rows.groupBy("key", "attribute", "valid_us", "known_us").agg(F.max("value").alias("value"))
    order = Window.partitionBy("key").orderBy("valid_us", "known_us")
    same = F.col("value").eqNullSafe(F.lag("value").over(order)) & (F.lag("known_us").over(order) <= F.col("known_us"))
    return rows.withColumn("_same", F.coalesce(same, F.lit(False))).where(~F.col("_same")).drop("_same")


def last_known(known: np.ndarray, start: np.ndarray, stop: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each probe the greatest index in [start, stop) whose ``known`` is <= limit, else -1.

    From a row known too late the search goes to the nearest earlier row known sooner. These
    links form chains along which ``known`` falls, so doubling the links finds the row in
    logarithmically many steps for all probes at once.
    """
    n = len(known)
    shifted = np.r_[np.iinfo(np.int64).min, known]  # indices are shifted by one; 0 stands for "none"
    sooner = np.maximum(np.arange(n + 1) - 1, 0)
    late = np.flatnonzero(shifted[sooner[1:]] >= known) + 1
    while len(late):  # all rows between a row and its link are known later than either, so links can be followed at once
        sooner[late] = sooner[sooner[late]]
        late = late[(shifted[sooner[late]] >= shifted[late]) & (sooner[late] > 0)]
    links = [sooner]
    while links[-1].any():
        links.append(links[-1][links[-1]])
    at = np.where(start < stop, stop, 0)
    for link in reversed(links):
        ahead = link[at]
        at = np.where((shifted[at] > limit) & (shifted[ahead] > limit), ahead, at)
    at = np.where(shifted[at] > limit, sooner[at], at)
    return np.where(at > start, at - 1, -1)


def _match(batches: Iterator[pa.RecordBatch], attributes: Sequence[str], payload: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, salt, kind): kind 0 is history, kind 1 events."""

    def answer(t: pa.Table) -> pa.RecordBatch | None:
        is_event = pc.equal(t.column("kind"), 1)
        events, hist = t.filter(is_event), t.filter(pc.invert(is_event))
        if not events.num_rows:
            return None
        names = pc.unique(t.column("key"))
        code = lambda x: pc.index_in(x.column("key"), names).to_numpy().astype(np.int64)
        e_code, e_valid, e_known = code(events), events.column("valid_us").to_numpy(), events.column("known_us").to_numpy()
        h_code, h_attr = code(hist), hist.column("attribute").to_numpy(zero_copy_only=False)
        h_valid, h_known = hist.column("valid_us").to_numpy(), hist.column("known_us").to_numpy()
        columns = [events.column(c).combine_chunks() for c in payload]
        for a in attributes:
            at = np.flatnonzero(h_attr == a)
            at = at[np.lexsort((h_known[at], h_valid[at], h_code[at]))]
            times = np.unique(np.r_[h_valid[at], e_valid])
            width = len(times) + 1
            h_at = h_code[at] * width + np.searchsorted(times, h_valid[at])
            stop = np.searchsorted(h_at, e_code * width + np.searchsorted(times, e_valid), side="right")
            start = np.searchsorted(h_at, e_code * width)
            got = last_known(h_known[at], start, stop, e_known)
            found = got >= 0
            where = pa.array(np.where(found, at[np.maximum(got, 0)] if len(at) else 0, 0), mask=~found)
            values = hist.column("value").combine_chunks() if hist.num_rows else pa.nulls(1, pa.string())
            columns += [values.take(where), pa.array(found)]
        return pa.RecordBatch.from_arrays(columns, names=[*payload, *(x for a in attributes for x in (a, f"{a}_found"))])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < CHUNK_ROWS:
            continue
        t = pa.Table.from_batches(held)
        if (r := answer(t)) is not None:
            yield r
        # the last key may go on: keep its history, its events so far are answered
        open_key = pc.and_(pc.equal(t.column("key"), t.column("key")[-1]), pc.equal(t.column("salt"), t.column("salt")[-1]))
        rest = t.filter(pc.and_(open_key, pc.equal(t.column("kind"), 0)))
        held, rows = rest.to_batches(), 0
    if held and (r := answer(pa.Table.from_batches(held))) is not None:
        yield r


def attributes_as_of(
    events: DataFrame,
    histories: Mapping[str, DataFrame],
    *,
    key: str,
    valid_us: str,
    known_us: str,
    payload: Sequence[str],
    types: Mapping[str, str],
    hot_events: int = HOT_EVENTS,
) -> DataFrame:
    """Each event with every attribute as of ``valid_us``, among what was known by ``known_us``.

    Result: ``payload`` columns of the event, then per attribute its value (cast to ``types``) and
    ``<attribute>_found``, which tells a null value from no version. Events with a null key or time
    come out with nothing found. Payload columns may bear any names but those of the attributes.
    Repeated events stay repeated; without events or histories the result is empty or finds nothing.
    """
    names = list(histories)
    inner = [f"__p{i}" for i in range(len(payload))]
    kinds = [dict(events.select(F.col(c).alias("c")).dtypes)["c"] for c in payload]
    never = F.lit(-(2**62))
    ev = events.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
        F.lit(1).alias("kind"),
        F.lit(None).cast("string").alias("attribute"),
        F.coalesce(F.col(valid_us), never).alias("valid_us"),
        F.when(F.col(key).isNull() | F.col(valid_us).isNull(), never).otherwise(F.coalesce(F.col(known_us), never)).alias("known_us"),
        F.lit(None).cast("string").alias("value"),
        *[F.col(c).alias(i) for c, i in zip(payload, inner)],
    )
    heavy = heavy_hitters(ev, "key", share=HOT_SHARE, weight_floor=hot_events)  # bounded by the share
    heavy = F.broadcast(heavy.select(F.col("key").alias("__hot"), F.ceil(F.col("est_rows") / hot_events).cast("int").alias("__salts")))
    spread = F.pmod(F.xxhash64("valid_us", "known_us", *inner), F.col("__salts")).cast("int")
    ev = ev.join(heavy, F.col("key") == F.col("__hot"), "left").withColumn("salt", F.coalesce(spread, F.lit(0))).drop("__hot", "__salts")
    hist = None
    for h in histories.values():
        hist = h if hist is None else hist.unionByName(h)
    every = F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__salts") - 1))
    hist = hist.join(heavy, F.col("key") == F.col("__hot"), "left").withColumn("salt", F.explode(every))
    empty = [F.lit(None).cast(t).alias(i) for i, t in zip(inner, kinds)]
    hist = hist.select("key", "salt", F.lit(0).alias("kind"), "attribute", "valid_us", "known_us", "value", *empty)
    out = ", ".join([f"{i} {t}" for i, t in zip(inner, kinds)] + [f"`{a}` string, `{a}_found` boolean" for a in names])
    sorted_rows = hist.unionByName(ev).repartition("key", "salt").sortWithinPartitions("key", "salt", "kind")
    matched = sorted_rows.mapInArrow(lambda it: _match(it, names, inner), out)
    found = [x for a in names for x in (F.col(a).cast(types[a]).alias(a), F.col(f"{a}_found"))]
    return matched.select(*[F.col(i).alias(c) for i, c in zip(inner, payload)], *found)
