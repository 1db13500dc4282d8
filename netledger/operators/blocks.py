"""Address blocks, distinct covered addresses, ranges of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cidr_blocks(df: DataFrame, start: str, count: str) -> DataFrame:
    """Each row's range ``[start, start + count)`` as the least set of aligned blocks ``net, len``.

    At level k the range covers the blocks numbered ceil(start / 2^k) to floor(end / 2^k); an odd
    first block or an odd end has no parent inside the range and is one of the set. So the levels
    are independent of each other and a row needs 33 of them, no loop. Other columns stay; ranges
    that are empty, negative or null give no rows.
    """
    a, b = F.col(start).cast("long"), F.col(start).cast("long") + F.col(count).cast("long")
    level = df.where(F.col(count) > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(32))))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_k"))
    lo = F.call_function("shiftright", a + size - 1, F.col("_k"))
    hi = F.call_function("shiftright", b, F.col("_k"))
    level = level.withColumns({"_lo": lo, "_hi": hi}).where("_lo < _hi")
    firsts = F.array(F.when(F.col("_lo") % 2 == 1, F.col("_lo")), F.when(F.col("_hi") % 2 == 1, F.col("_hi") - 1))
    block = level.withColumn("_block", F.explode(F.array_distinct(F.filter(firsts, lambda x: x.isNotNull()))))
    return block.withColumns({"net": F.call_function("shiftleft", F.col("_block"), F.col("_k")), "len": (F.lit(32) - F.col("_k")).cast("int")}).drop("_k", "_lo", "_hi", "_block")


def covered_space(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, family, num_ip``: IPv4 addresses and IPv6 networks of length 64 that prefixes ``(net, len)`` cover.

    The space of each family is cut into equal parts (/12, /20) and wider prefixes are split along
    them, so the running maximum of each key sorts its parts separately; sums over parts are exact. Repeated
    and nested prefixes count once. Half of all IPv6 space, 2^63, is too much for a sum.
    """
    h, four = F.col("net.hi"), F.col("net.fam") == 4
    base = df.select(*keys, "net", "len").where(F.col("net").isNotNull() & F.col("len").isNotNull()).distinct()
    bits = F.col("len") + F.when(four, 32).otherwise(0)
    beyond = F.when(bits < 64, F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), bits)).otherwise(F.lit(0).cast("long"))
    # IPv4 as its number, IPv6 with the sign turned, so that signed order is the order of addresses
    sign = F.lit(-(2**63)).cast("long")
    s = F.when(four, F.call_function("shiftrightunsigned", h, F.lit(32))).otherwise(h.bitwiseXOR(sign))
    last = F.when(four, F.call_function("shiftrightunsigned", h, F.lit(32)).bitwiseOR(beyond)).otherwise(h.bitwiseOR(beyond).bitwiseXOR(sign))
    step = F.when(four, F.lit(2**20).cast("long")).otherwise(F.lit(2**44).cast("long"))
    spans = base.select(*keys, F.col("net.fam").alias("family"), "len", s.alias("s"), last.alias("last"), step.alias("step"))
    four = F.col("family") == 4
    wide = F.when(F.col("len") < F.when(four, 12).otherwise(20), F.sequence("s", "last", "step"))
    pieces = spans.select(*keys, "family", "last", "step", F.explode(F.coalesce(wide, F.array("s"))).alias("s"))
    shard = F.call_function("shiftright", F.col("s"), F.when(four, 20).otherwise(44))
    pieces = pieces.withColumn("shard", shard).withColumn("last", F.least("last", F.col("s").bitwiseOR(F.col("step") - 1)))
    # prefixes nest or are disjoint, so one running maximum per part is enough
    before = F.max("last").over(Window.partitionBy(*keys, "family", "shard").orderBy("s", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1))
    reach = pieces.withColumn("reach", before)
    fresh = F.when(F.col("reach").isNull() | (F.col("reach") < F.col("s")), F.col("last") - F.col("s") + 1).otherwise(F.greatest(F.lit(0).cast("long"), F.col("last") - F.col("reach")))
    return reach.withColumn("fresh", fresh).groupBy(*keys, "family").agg(F.sum("fresh").alias("num_ip"))


def number_ranges(df: DataFrame, start: str, count: str, name: str) -> DataFrame:
    """One row for each number of a range; empty and null ranges give none."""
    return df.where(F.col(count) > 0).withColumn(name, F.explode(F.sequence(F.col(start), F.col(start) + F.col(count) - 1))).drop(start, count)
