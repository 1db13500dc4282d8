"""Added, removed and changed records between consecutive full snapshots.

Rows are reduced to a 128-bit key hash, the snapshot's number within its source and a 64-bit row
hash, and shuffled once by key hash, so a source that holds most rows spreads over all buckets, whose number
follows from the row count. In each bucket numpy sorts the compact arrays and finds set differences with
``searchsorted``; only the differing keys go back to the table for their full values, into the scan if
there are few.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netledger.session import cut

#: Rows of a bucket that one task sorts: some 100 MB.
BUCKET_ROWS = 1_000_000
#: Rows of a list that go to every task of a scan at most, some 20 MB.
SMALL_LIST = 200_000


def few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has at most ``SMALL_LIST`` rows, counted; else as it is."""
    return F.broadcast(df) if df.limit(SMALL_LIST + 1).count() <= SMALL_LIST else df


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: rows (k1, k2, sid, ord, last, row_hash), one per key and snapshot."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    k1, k2, ordinal, last, row_hash = (table.column(c).to_numpy() for c in ("k1", "k2", "ord", "last", "row_hash"))
    order = np.lexsort((ordinal, k2, k1))
    k1, k2, ordinal, last, row_hash = (x[order] for x in (k1, k2, ordinal, last, row_hash))
    key = np.cumsum(np.r_[0, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]).astype(np.int64)
    code = key * (int(ordinal.max()) + 3) + ordinal + 1  # sorted; a key's neighbours in time are code - 1 and code + 1
    at = np.minimum(np.searchsorted(code, code - 1), len(code) - 1)
    had = code[at] == code - 1
    to = np.minimum(np.searchsorted(code, code + 1), len(code) - 1)
    stays = code[to] == code + 1
    added = np.flatnonzero(~had & (ordinal > 1))
    removed = np.flatnonzero(~stays & (ordinal < last))
    changed = np.flatnonzero(had & (row_hash[at] != row_hash))
    for kind, rows, step in (("added", added, 0), ("removed", removed, 1), ("changed", changed, 0)):
        if len(rows):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(k1[rows]),
                    pa.array(k2[rows]),
                    pa.array((ordinal[rows] + step).astype(np.int64)),
                    pa.array(ordinal[rows].astype(np.int64)),
                    pa.array([kind] * len(rows)),
                ],
                names=["k1", "k2", "at_ord", "held_ord", "change_kind"],
            )


def snapshot_changes(
    df: DataFrame,
    *,
    source: str,
    snapshot: str,
    key: Sequence[str],
    values: Sequence[str],
    latest: str | None = None,
) -> DataFrame:
    """``(snapshot, *key, change_kind)``: what changed against the source's previous snapshot.

    ``key`` includes ``source``. A snapshot exists for a source where it has any row; the first one
    yields nothing. Nulls in a key or value equal each other, an empty text differs from null.
    Rows of one key in one snapshot count once; if they differ, the one with the greatest
    ``latest`` stands (ties: greatest row hash). Rows with a null snapshot or null source are in no
    snapshot. Removed keys are reported under the later snapshot. Extra columns are ignored; an
    empty table gives no rows.
    """
    # a null must not hash like "no column": its position enters the hash
    marked: list[Column] = []
    for i, c in enumerate(values):
        marked += [F.when(F.col(c).isNull(), F.lit(-1 - i)).otherwise(F.lit(i)), F.col(c)]
    keyed: list[Column] = []
    for i, c in enumerate(key):
        keyed += [F.when(F.col(c).isNull(), F.lit(-1 - i)).otherwise(F.lit(i)), F.col(c)]
    base = df.where(F.col(snapshot).isNotNull() & F.col(source).isNotNull())
    ids = [F.xxhash64(*keyed).alias("k1"), F.xxhash64(F.lit(7919), *reversed(keyed)).alias("k2")]

    src, snap = F.col(source).alias("__src"), F.col(snapshot).alias("__snap")

    dates = base.select(src, snap).distinct()
    by_date = Window.partitionBy("__src").orderBy("__snap")
    numbered = dates.select("__src", "__snap", F.row_number().over(by_date).alias("ord"), F.count(F.lit(1)).over(Window.partitionBy("__src")).cast("int").alias("last"))
    numbered = cut(numbered, "snapshots")  # one row a source and snapshot

    session = df.sparkSession
    buckets = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // BUCKET_ROWS))
    compact = base.select(src, snap, *ids, F.xxhash64(*marked).alias("row_hash"), (F.col(latest) if latest else F.lit(0)).alias("seen")).join(few(numbered), ["__src", "__snap"])
    # one shuffle: rows of a key meet in a bucket, where repeated rows of a snapshot are reduced to the latest
    bucket = compact.select("k1", "k2", "ord", "last", "seen", "row_hash").repartition(buckets, "k1")
    once = bucket.groupBy("k1", "k2", "ord", "last").agg(F.max(F.struct("seen", "row_hash")).alias("pick"))
    arrays = once.select("k1", "k2", "ord", "last", F.col("pick.row_hash").alias("row_hash"))
    diff = few(cut(arrays.mapInArrow(_differences, "k1 long, k2 long, at_ord long, held_ord long, change_kind string"), "differing-keys"))

    keys = [F.col(c).alias(f"key_{i}") for i, c in enumerate(key)]
    full = base.select(src, snap, *ids, *keys).join(few(numbered.select("__src", "__snap", F.col("ord").cast("long").alias("held_ord"))), ["__src", "__snap"])
    named = full.join(diff, ["k1", "k2", "held_ord"]).groupBy("k1", "k2", "held_ord", "change_kind", "__src", "at_ord").agg(
        *[F.first(f"key_{i}").alias(f"key_{i}") for i in range(len(key))]
    )
    when = numbered.select("__src", "__snap", F.col("ord").cast("long").alias("at_ord"))
    return named.join(few(when), ["__src", "at_ord"]).select(F.col("__snap").alias(snapshot), *[F.col(f"key_{i}").alias(c) for i, c in enumerate(key)], "change_kind")
