"""Per-key results when a handful of keys hold most of the rows.

Heavy keys are found with a mergeable frequent-items sketch, so detection shuffles one small
sketch per partition. Their number is bounded by the share asked for, so the list of heavy keys
can always be broadcast. Rows of heavy keys take a salted path, the rest the ordinary shuffle,
and both are united.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items the sketch tracks; its error is at most 3.5 / this share of the rows.
SKETCH_ITEMS = 4096


def heavy_hitters(df: DataFrame, key: str, *, share: float = 0.01, weight_floor: int = 0) -> DataFrame:
    """Keys that may hold at least ``share`` of all rows: ``(key, est_rows)``, fewer than ``2 / share``.

    The sketch never misses such a key as long as ``share`` exceeds twice its error, checked here;
    a few lighter keys may come along, which does no harm since callers count exactly.
    Null keys are no keys. An empty table gives no rows.
    """
    if not 2 * 3.5 / SKETCH_ITEMS <= share <= 1:
        raise ValueError("share is outside what the sketch can tell apart")
    k = int(2 / share) + 1  # a key so found has half the share at least, as the error is below that
    counted = df.select(F.col(key).alias("__k")).agg(
        F.expr(f"approx_top_k(__k, {k}, {SKETCH_ITEMS})").alias("__top"), F.count(F.lit(1)).alias("__n")
    )
    rows = counted.select(F.explode("__top").alias("__t"), "__n").select(F.col("__t.item").alias("__k"), F.col("__t.count").alias("__est"), "__n")
    heavy = rows.where(F.col("__k").isNotNull() & (F.col("__est") + F.col("__n") * (3.5 / SKETCH_ITEMS) >= F.col("__n") * share) & (F.col("__est") >= weight_floor))
    return heavy.select(F.col("__k").alias(key), F.col("__est").alias("est_rows"))


def per_key_profile(
    df: DataFrame,
    key: str,
    *,
    distinct: Mapping[str, str] | None = None,
    share: float = 0.01,
    salts: int = 64,
    count_name: str = "n_rows",
) -> DataFrame:
    """Rows and distinct values per non-null key without a few long tasks.

    ``distinct`` maps an output column to the column whose non-null distinct values are counted.
    Heavy keys are marked by a broadcast join with the bounded heavy-hitter list and aggregated
    by ``(key, salt, value)`` first, the salt being a hash of the counted value, so the distinct
    values of a heavy key spread over all tasks and their counts add up exactly. Other keys take one
    ordinary hash aggregation. Repeated rows count; an empty table gives no rows; extra columns are
    ignored, whatever their names.
    """
    distinct = dict(distinct or {})
    values = {c: f"__v{i}" for i, c in enumerate(dict.fromkeys(distinct.values()))}
    base = df.select(F.col(key).alias("__key"), *[F.col(c).alias(v) for c, v in values.items()]).where(F.col("__key").isNotNull())
    heavy = heavy_hitters(df, key, share=share).select(F.col(key).alias("__heavy"))
    marked = base.join(F.broadcast(heavy), F.col("__key") == F.col("__heavy"), "left").withColumn("__hot", F.col("__heavy").isNotNull()).drop("__heavy")

    light = (
        marked.where(~F.col("__hot"))
        .groupBy("__key")
        .agg(F.count(F.lit(1)).alias("__rows"), *(F.countDistinct(values[c]).alias(f"__d{i}") for i, c in enumerate(distinct.values())))
    )
    hot = marked.where("__hot")
    united = hot.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).withColumn("__m", F.lit("__rows"))
    for i, c in enumerate(distinct.values()):
        v = values[c]
        salted = hot.where(F.col(v).isNotNull()).groupBy("__key", F.pmod(F.xxhash64(v), F.lit(salts)).alias("__salt"), v).agg(F.lit(1).alias("__one"))
        united = united.unionByName(salted.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).withColumn("__m", F.lit(f"__d{i}")))
    names = {"__rows": count_name} | {f"__d{i}": o for i, o in enumerate(distinct)}
    pick = lambda m: F.coalesce(F.max(F.when(F.col("__m") == m, F.col("__n"))), F.lit(0).cast("long")).alias(m)
    both = light.unionByName(united.groupBy("__key").agg(*map(pick, names)))
    return both.select(F.col("__key").alias(key), *[F.col(m).alias(o) for m, o in names.items()])


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys holding at least ``share`` of all rows, null-key rows included in the total: ``(key, n_rows)``."""
    total = df.agg(F.count(F.lit(1))).scalar()
    heavy = per_key_profile(df, key, share=share / 2, count_name="__rows").where(F.col("__rows") >= total * share)
    return heavy.select(F.col(key), F.col("__rows").alias("n_rows"))
