"""Transfer logs: nested JSON to one row a prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netledger.functions.ip import common_prefix_len, ipv4_to_long, long_to_ipv4, mask4

_ORG = "struct<name: string>"
_LOG = f"struct<type: string, transfer_date: string, source_rir: string, recipient_rir: string, source_organization: {_ORG}, recipient_organization: {_ORG}, ip4nets: string>"
_NETS = "array<struct<transfer_set: array<struct<start_address: string, end_address: string>>>>"


def read_transfers(spark: SparkSession, path: str) -> DataFrame:
    """Logs as downloaded: one JSON document a file with an array ``transfers``."""
    raw = spark.read.schema(f"transfers array<{_LOG}>").option("multiLine", True).json(path)
    return flatten_transfers(raw.select(F.explode("transfers").alias("t")).select("t.*"))


def parse_transfers(df: DataFrame, text: str) -> DataFrame:
    """The same from a column holding one transfer as JSON text."""
    return flatten_transfers(df.select(F.from_json(text, _LOG).alias("t")).select("t.*"))


def flatten_transfers(logs: DataFrame) -> DataFrame:
    """``date, prefix_addr, prefix_len, from_rir, from_isp, to_rir, to_isp, transfer_type``.

    ``ip4nets`` may be a list or a single object. Each address range becomes the prefix both ends share;
    equal ends make a /32. Logs without IPv4 networks, IPv6 ranges and malformed addresses give no rows;
    a missing organisation is null.
    """
    rir = lambda c: F.when(F.col(c) == "RIPE NCC", "RIPE").otherwise(F.col(c))
    nets = logs.select("*", F.explode(F.from_json("ip4nets", _NETS)).alias("n")).select("*", F.explode("n.transfer_set").alias("r"))
    ends = nets.withColumns({"_a": ipv4_to_long("r.start_address"), "_b": ipv4_to_long("r.end_address")}).where("_a is not null and _b is not null")
    ends = ends.withColumn("prefix_len", common_prefix_len("_a", "_b"))
    return ends.select(
        F.regexp_replace(F.split_part("transfer_date", F.lit("T"), F.lit(1)), "-", "").try_cast("int").alias("date"), long_to_ipv4(mask4("_a", "prefix_len")).alias("prefix_addr"), "prefix_len",
        rir("source_rir").alias("from_rir"), F.col("source_organization.name").alias("from_isp"), rir("recipient_rir").alias("to_rir"),
        F.col("recipient_organization.name").alias("to_isp"), F.col("type").alias("transfer_type"),
    )
