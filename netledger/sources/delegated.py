"""Delegation statistics ``registry|cc|type|start|value|date|status[|id]``, plain, gz or bz2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netledger.functions.ip import asn_to_long, ipv4_to_long
from netledger.operators.blocks import cidr_blocks, number_ranges
from netledger.sources.landing import file_day

_SCHEMA = "rir string, cc string, kind string, start string, value string, registered string, status string, opaque_id string"


def read_delegated(spark: SparkSession, path: str) -> DataFrame:
    """Typed lines with the file's day; comments, version and summary lines and short lines go."""
    raw = spark.read.schema(_SCHEMA).option("sep", "|").option("comment", "#").option("quote", "").csv(path)
    t = raw.select("*", file_day().alias("date")).withColumn("n", F.col("value").try_cast("long"))
    return t.where(F.col("kind").isin("ipv4", "ipv6", "asn") & F.col("status").isNotNull() & (F.col("start") != "*"))


def ipv4_prefixes(d: DataFrame) -> DataFrame:
    """Aligned blocks ``net, len`` of every IPv4 range, whatever its count."""
    v4 = d.where("kind = 'ipv4'").select("date", "rir", "cc", "registered", "status", ipv4_to_long("start").alias("_start"), "n").where(F.col("_start").isNotNull())
    return cidr_blocks(v4, "_start", "n").drop("_start", "n")


def ipv6_prefixes(d: DataFrame) -> DataFrame:
    return d.where("kind = 'ipv6'").select("date", "rir", "cc", "registered", "status", F.col("start").alias("prefix_addr"), F.col("n").cast("int").alias("prefix_len"))


def numbers(d: DataFrame) -> DataFrame:
    """One row an AS number; starts may be in asdot."""
    asn = d.where("kind = 'asn'").select("date", "rir", "cc", "registered", "status", asn_to_long("start").alias("_start"), "n").where(F.col("_start").isNotNull())
    return number_ranges(asn, "_start", "n", "asn")
