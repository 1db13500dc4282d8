"""Delimited text rows of dumps and earlier jobs, in their several forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netledger.functions.ip import asn_to_long


def _fields(df: DataFrame, line: str, sep: str) -> DataFrame:
    return df.where(F.col(line).isNotNull()).select(F.split(line, sep).alias("f")).withColumn("n", F.size("f"))


def _at(i) -> Column:
    return F.get("f", F.lit(i) if isinstance(i, int) else i)


def dump_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """``vantage, date, prefix_addr, prefix_len, origin`` of textual update dumps.

    Lines begin with ``BGP4MP`` (then the vantage point is ``verbose``) or with a vantage point before it.
    The time is an epoch second or ``%m/%d/%y  %H:%M:%S``. Lines whose last hop is a set or no number, and
    short or malformed lines, go.
    """
    t = _fields(df, line, "[|]").where("n >= 8")
    verbose = _at(0) == "BGP4MP"
    k = F.when(verbose, F.lit(0)).otherwise(F.lit(1))
    when = F.trim(_at(k + 1))
    clock = F.to_date(F.try_to_timestamp(F.regexp_replace(when, " +", " "), F.lit("MM/dd/yy HH:mm:ss")))
    day = F.when(when.contains("/"), clock).otherwise(F.to_date(F.timestamp_seconds(when.try_cast("long"))))
    prefix, path = _at(k + 5), F.split(_at(k + 6), " ")
    rows = t.select(
        F.when(verbose, "verbose").otherwise(_at(0)).alias("vantage"), F.date_format(day, "yyyyMMdd").cast("int").alias("date"),
        F.split_part(prefix, F.lit("/"), F.lit(1)).alias("prefix_addr"), F.split_part(prefix, F.lit("/"), F.lit(2)).try_cast("int").alias("prefix_len"),
        asn_to_long(F.element_at(path, -1)).alias("origin"),
    )
    return rows.where("date is not null and prefix_len is not null and origin is not null")


def active_rows(df: DataFrame, line: str = "value") -> DataFrame:
    """``date, source, prefix_addr, prefix_len, origin, validation``; the old form of five columns has the
    date last and no source, which was RADB."""
    t = _fields(df, line, "\t").where(F.col("n").isin(5, 6))
    old = F.col("n") == 5
    pick = lambda a, b: F.when(old, _at(a)).otherwise(_at(b))
    return t.select(
        pick(4, 0).try_cast("int").alias("date"), F.when(old, "RADB").otherwise(_at(1)).alias("source"), pick(0, 2).alias("prefix_addr"),
        pick(1, 3).try_cast("int").alias("prefix_len"), pick(2, 4).try_cast("long").alias("origin"), pick(3, 5).alias("validation"),
    )


def overlap_rows(df: DataFrame, line: str = "value") -> DataFrame:
    """``date, source, prefix, roa_records, irr_records``: nested lists of three and of two fields.

    Rows of five columns have no source, which was RADB. Partial overlaps and IPv6 prefixes go; each row
    comes once more under all registries.
    """
    t = _fields(df, line, "\t").where(F.col("n").isin(5, 6))
    k = F.col("n") - 4
    nested = lambda c, m: F.transform(F.split(c, "[|]"), lambda r: F.slice(F.split(r, ","), 1, m))
    source = F.when(F.col("n") == 5, "RADB").otherwise(_at(1))
    rows = t.select(_at(0).try_cast("int").alias("date"), source.alias("source"), _at(k).alias("prefix"), _at(k + 1).alias("rel"), nested(_at(k + 2), 3).alias("roa_records"), nested(_at(k + 3), 2).alias("irr_records"))
    kept = rows.where((F.col("rel") != "partial") & ~F.col("prefix").contains(":")).drop("rel")
    return kept.withColumn("source", F.explode(F.array("source", F.lit("ALL-IRR"))))
