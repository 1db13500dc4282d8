"""Snapshots of organisations and relationships of networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netledger.sources.landing import file_day, read_delimited


def read_as_org(spark: SparkSession, path: str) -> DataFrame:
    """``snapshot, asn, org, country``: networks joined to their organisations.

    A file holds two tables one after the other, each behind a ``# format:`` line naming its columns, so
    a file (some MB) is one record here. The fourth column of a network is its organisation in either
    form of the table. A network of an unknown organisation has nulls.
    """
    text = spark.read.text(path, wholetext=True).select(file_day().alias("snapshot"), "value")
    part = text.select("snapshot", F.explode(F.split("value", r"#\s*format\s*:")).alias("part"))
    part = part.select("snapshot", F.split("part", "\n").alias("lines")).select("snapshot", F.trim(F.get("lines", F.lit(0))).alias("head"), "lines")
    rows = part.select("snapshot", "head", F.explode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    rows = rows.where(~F.col("line").startswith("#") & (F.trim("line") != "")).withColumn("f", F.split(F.regexp_replace("line", "\r", ""), "[|]"))
    get = lambda i: F.get("f", F.lit(i))
    orgs = rows.where(F.col("head").startswith("org_id")).select("snapshot", get(0).alias("org_id"), get(2).alias("org"), get(3).alias("country")).dropDuplicates(["snapshot", "org_id"])
    nets = rows.where(F.col("head").startswith("aut")).select("snapshot", get(0).try_cast("long").alias("asn"), get(3).alias("org_id")).where(F.col("asn").isNotNull())
    return nets.join(orgs, ["snapshot", "org_id"], "left").select("snapshot", "asn", F.nullif("org", F.lit("")).alias("org"), F.nullif("country", F.lit("")).alias("country"))


def read_as_rel(spark: SparkSession, path: str) -> DataFrame:
    """``snapshot, as1, as2, rel``: -1 means as1 is the provider of as2, else peers."""
    raw = read_delimited(spark, path, "as1 long, as2 long, rel int", sep="|")
    return raw.select(file_day().alias("snapshot"), "as1", "as2", "rel").where(F.col("as1").isNotNull() & F.col("as2").isNotNull())
