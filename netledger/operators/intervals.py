"""Continuous periods and gaps of overlapping half-open spans per entity.

The aggregate state is a sorted list of disjoint spans ``[lo, hi)``; spans that touch are one.
States merge associatively, so they are combined as a reduction tree:

1. every scan task reduces its own rows to one list per entity and slice (numpy, no shuffle);
2. one shuffle on ``(entity, slice)`` merges the partial lists;
3. only entities split over several slices are stitched: the latest end of all earlier slices is
   carried into each slice, which clips its list.

Entities with more than ``hot_rows`` rows (found by a frequent-items sketch) are cut into slices
of their own time range, so no task ever holds more than a slice of a hot entity. The number of
hot entities is bounded by the sketch, hence broadcastable.

Rows with a null entity, a null bound or ``hi <= lo`` cover nothing. Repeated rows change nothing.
Empty input gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netledger.operators.skew import heavy_hitters

HOT_ROWS = 500_000
#: Rows a scan task gathers before it reduces them to partial lists.
FLUSH_ROWS = 400_000
_LISTS = "entity string, slice long, los array<long>, his array<long>"


def _merge_order(group: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Order by (group, lo)."""
    number = int(group.max()) + 1
    least, most = np.full(number, np.iinfo(np.int64).max), np.full(number, np.iinfo(np.int64).min)
    np.minimum.at(least, group, lo)
    np.maximum.at(most, group, lo)
    held = least <= most
    width = np.where(held, most.astype(np.float64) - least + 1, 0.0)
    if width.sum() > 2.0**62:
        return np.lexsort((lo, group))
    start = np.r_[0, np.cumsum(np.where(held, most - np.where(held, least, 0) + 1, 0))[:-1]]
    return np.argsort(start[group] + (lo - least[group]), kind="stable")


def merge_sorted(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint spans per group from spans in any order.

    Where all groups fit into one range of numbers, a group's spans are laid behind the last one's, and
    numpy's stable sort finds the presorted lists and merges them in a tree, so lists of partial states
    are merged in linear passes and not sorted anew.
    """
    if not len(lo):
        return group, lo, hi
    order = _merge_order(group, lo)
    group, lo, hi = group[order], lo[order], hi[order]
    # running maximum of hi that restarts at every group: shift each group into its own value range
    _, dense = np.unique(hi, return_inverse=True)
    first = np.r_[True, group[1:] != group[:-1]]
    number = np.cumsum(first) - 1
    width = int(dense.max()) + 1
    reach = np.maximum.accumulate(dense + number * width) - number * width
    values = np.empty(width, dtype=hi.dtype)
    values[dense] = hi
    top = values[reach]
    starts = first.copy()
    starts[1:] |= lo[1:] > top[:-1]
    at = np.flatnonzero(starts)
    ends = np.r_[at[1:], len(lo)] - 1
    return group[at], lo[at], top[ends]


def _as_lists(names: pa.Array, slices: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """One row per group; ``names`` and ``slices`` are indexed by group number."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.r_[first, len(group)].astype(np.int32))
    which = group[first]
    return pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(which)),
            pa.array(slices[which], pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.array(lo, pa.int64())),
            pa.ListArray.from_arrays(offsets, pa.array(hi, pa.int64())),
        ],
        names=["entity", "slice", "los", "his"],
    )


def _groups(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names and slices by group number, and the group number of each row."""
    coded = table.column("entity").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    slices = table.column("slice").to_numpy()
    if not slices.any():
        return coded.dictionary, np.zeros(len(coded.dictionary), dtype=np.int64), codes
    kinds, slice_no = np.unique(slices, return_inverse=True)
    pairs, number = np.unique(codes * len(kinds) + slice_no, return_inverse=True)
    return coded.dictionary.take(pa.array(pairs // len(kinds))), kinds[pairs % len(kinds)], number


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan side: rows with single bounds, or with lists of bounds, to partial lists."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        names, slices, group = _groups(table)
        lo, hi = table.column("lo").combine_chunks(), table.column("hi").combine_chunks()
        return _as_lists(names, slices, *merge_sorted(group, lo.to_numpy(), hi.to_numpy()))

    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= FLUSH_ROWS:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def _partial_offsets(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Scan side for rows that hold a list of present offsets: offset x covers [x, x+1)."""
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column("offsets")
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        row = np.repeat(np.arange(b.num_rows), sizes)
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        x = flat.fill_null(low - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        keep = known & (x >= low) & (x <= high)
        names, slices, group = _groups(pa.Table.from_batches([b]))
        yield _as_lists(names, slices, *merge_sorted(group[row[keep]], x[keep], x[keep] + 1))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: rows come sorted by (entity, slice); lists of one pair become one list."""
    held: pa.Table | None = None
    least = 0

    def merged(table: pa.Table) -> pa.RecordBatch:
        names, slices, row_group = _groups(table)
        los, his = table.column("los").combine_chunks(), table.column("his").combine_chunks()
        sizes = los.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.repeat(row_group, sizes)
        return _as_lists(names, slices, *merge_sorted(group, los.flatten().to_numpy(), his.flatten().to_numpy()))

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        entity, piece = held.column("entity")[-1].as_py(), held.column("slice")[-1].as_py()
        first_entity, first_piece = held.column("entity")[0].as_py(), held.column("slice")[0].as_py()
        if (entity, piece) == (first_entity, first_piece):  # still one group: keep its state only
            if held.nbytes > 2 * least:  # merged anew only once it has doubled, so a long group costs no more than its rows
                held = pa.Table.from_batches([merged(held)])
                least = max(held.nbytes, 1 << 20)
            continue
        least = 0
        import pyarrow.compute as pc

        last = pc.and_(pc.equal(held.column("entity"), entity), pc.equal(held.column("slice"), piece))
        yield merged(held.filter(pc.invert(last)))
        held = held.filter(last)
    if held is not None:
        yield merged(held)


def _sliced(df: DataFrame, hot_rows: int) -> tuple[DataFrame, bool]:
    """Add ``slice``; the flag tells whether any entity is cut into several."""
    heavy = heavy_hitters(df, "entity", share=0.002, weight_floor=hot_rows)
    hot = df.join(F.broadcast(heavy.select("entity")), "entity", "left_semi").groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo0"), F.max("lo").alias("lo1")
    ).where(F.col("n") > hot_rows)
    found = hot.collect()  # bounded by the sketch's k, a few hundred rows at most
    if not found:
        return df.withColumn("slice", F.lit(0).cast("long")), False
    rows = [(r.entity, r.lo0, max(1, -(-(r.lo1 - r.lo0 + 1) // -(-r.n // hot_rows)))) for r in found]
    cuts = df.sparkSession.createDataFrame(rows, "entity string, lo0 long, width long")
    wide = df.join(F.broadcast(cuts), "entity", "left")
    slice_no = F.coalesce(F.expr("(lo - lo0) div width"), F.lit(0).cast("long"))
    return wide.withColumn("slice", slice_no).select("entity", "slice", "lo", "hi"), True


def disjoint_spans(df: DataFrame, entity: str, lo: str, hi: str, *, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """Sorted disjoint lists ``(entity, slice, los, his)`` of BIGINT spans, clipped so that slices of
    an entity neither overlap nor contain one another; the flag tells whether any entity is sliced."""
    rows = df.select(F.col(entity).cast("string").alias("entity"), F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"))
    rows = rows.where(F.col("entity").isNotNull() & (F.col("hi") > F.col("lo")))
    rows, cut_up = _sliced(rows, hot_rows)
    return _reduced(rows.select("entity", "slice", "lo", "hi").mapInArrow(_partial, _LISTS), cut_up), cut_up


def disjoint_offsets(df: DataFrame, entity: str, offsets: str, low: int, high: int) -> DataFrame:
    """The same lists from rows holding an array of present whole-number offsets in ``low..high``.

    An entity's state has at most ``(high - low) / 2 + 1`` spans, so no entity needs slices.
    Null or empty arrays and null elements cover nothing.
    """
    rows = df.select(F.col(entity).cast("string").alias("entity"), F.lit(0).cast("long").alias("slice"), F.col(offsets).cast("array<int>").alias("offsets"))
    rows = rows.where(F.col("entity").isNotNull() & F.col("offsets").isNotNull())
    return _reduced(rows.mapInArrow(lambda it: _partial_offsets(it, low, high), _LISTS), False)


def _reduced(partial: DataFrame, cut_up: bool) -> DataFrame:
    merged = partial.repartition("entity", "slice").sortWithinPartitions("entity", "slice").mapInArrow(_merge, _LISTS)
    if not cut_up:
        return merged
    sliced = merged.withColumn("top", F.element_at("his", -1))
    earlier = Window.partitionBy("entity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = sliced.select("entity", "slice", F.max("top").over(earlier).alias("carry"))
    joined = sliced.join(carry, ["entity", "slice"])
    spans = F.arrays_zip(F.col("los").alias("lo"), F.col("his").alias("hi"))
    rest = F.filter(spans, lambda s: F.col("carry").isNull() | (s["hi"] > F.col("carry")))
    clipped = joined.select("entity", "slice", "carry", rest.alias("rest")).where(F.size("rest") > 0)
    return clipped.select(
        "entity",
        "slice",
        "carry",
        F.transform("rest", lambda s: F.greatest(s["lo"], F.col("carry"))).alias("los"),
        F.transform("rest", lambda s: s["hi"]).alias("his"),
    )


def gaps(lists: DataFrame, cut_up: bool = False) -> DataFrame:
    """``(entity, gap_lo, gap_hi)``: maximal uncovered spans between first and last covered point."""
    froms, tos = F.col("his"), F.expr("slice(los, 2, greatest(size(los) - 1, 0))")
    if cut_up:  # the carried end opens a gap before the first span of a later slice
        froms = F.when(F.col("carry").isNull(), F.col("his")).otherwise(F.concat(F.array("carry"), F.col("his")))
        tos = F.when(F.col("carry").isNull(), tos).otherwise(F.col("los"))
    pairs = F.arrays_zip(froms.alias("gap_lo"), tos.alias("gap_hi"))
    return lists.select("entity", F.inline(pairs)).toDF("entity", "gap_lo", "gap_hi").where(F.col("gap_hi") > F.col("gap_lo"))


def periods(lists: DataFrame, cut_up: bool = False) -> DataFrame:
    """``(entity, lo, hi)``: the continuous covered periods."""
    pairs = F.arrays_zip(F.col("los").alias("lo"), F.col("his").alias("hi"))
    if not cut_up:
        return lists.select("entity", F.inline(pairs)).toDF("entity", "lo", "hi")
    flat = lists.select("entity", F.size("los").alias("n"), F.posexplode(pairs)).select("entity", "n", "pos", "col.lo", "col.hi")
    edge = (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)
    # only the first and last span of a slice can touch another slice: two rows a slice
    order = Window.partitionBy("entity").orderBy("lo", "hi")
    edges = flat.where(edge).withColumn("new", F.coalesce((F.col("lo") > F.lag("hi").over(order)).cast("int"), F.lit(1)))
    joined = edges.withColumn("no", F.sum("new").over(order)).groupBy("entity", "no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return flat.where(~edge).select("entity", "lo", "hi").unionByName(joined.drop("no"))
