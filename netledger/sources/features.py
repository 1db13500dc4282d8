"""Feature rows whose organisation may hold commas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEADING, FEATURES = 9, 312
_NAMES = ("date", "prefix_addr", "prefix_len", "origin", "isp", "rir", "validation", "sum_rel", "source")


def parse_feature_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Nine typed leading columns, ``record_type`` and ``features`` (array of 312 doubles, null if inactive).

    The fifth column takes up what exceeds 9 or 321 tokens. Shorter lines and lines whose numbers don't
    parse go. A remark behind the origin is ignored.
    """
    t = df.select(F.split(line, ",").alias("t")).withColumn("n", F.size("t")).where(F.col("n") >= LEADING)
    wide = F.col("n") >= LEADING + FEATURES
    extra = F.when(wide, F.col("n") - LEADING - FEATURES).otherwise(F.col("n") - LEADING)
    t = t.withColumn("x", extra)
    tail = F.slice("t", F.lit(6) + F.col("x"), F.lit(4))
    isp = F.array_join(F.slice("t", F.lit(5), F.lit(1) + F.col("x")), ",")
    at = lambda i: F.get("t", F.lit(i))
    rest = lambda i: F.get(tail, F.lit(i))
    numbers = F.transform(F.slice("t", F.lit(10) + F.col("x"), F.lit(FEATURES)), lambda v: v.try_cast("double"))
    origin = F.split_part(at(3), F.lit("#"), F.lit(1)).try_cast("long")
    cols = (at(0).try_cast("int"), at(1), at(2).try_cast("int"), origin, isp, rest(0), rest(1), rest(2), rest(3))
    rows = t.select(*[c.alias(n) for c, n in zip(cols, _NAMES)], F.when(wide, numbers).alias("features"))
    v = F.col("validation")
    kind = F.when(F.col("features").isNull(), "inactive").when((v == "invalid") & (F.col("sum_rel") != "none"), "excluded").when(v.isin("valid", "invalid"), "covered").otherwise("not-covered")
    return rows.where(F.col("date").isNotNull() & F.col("prefix_len").isNotNull() & F.col("origin").isNotNull()).withColumn("record_type", kind)
