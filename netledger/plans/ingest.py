"""Landed files to the typed tables the queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netledger.functions.ip import address_text, asn_to_long, num_addresses, with_net
from netledger.operators.registry import attribute_rir

# fixed values: trust anchors in the host of a payload's address, and their registries
ANCHORS = {"ripe": "ripencc", "ripencc": "ripencc", "apnic": "apnic", "arin": "arin", "afrinic": "afrinic", "lacnic": "lacnic"}


def _enriched(rows: DataFrame, blocks: DataFrame, orgs: DataFrame) -> DataFrame:
    """Registry by the shortest delegated block, organisation by number; rows that are no prefix go."""
    nets = with_net(rows.withColumn("_p", F.concat_ws("/", "prefix_addr", F.col("prefix_len").cast("string"))), "_p").drop("_p")
    rir = attribute_rir(nets, blocks, ["date", "net", "len"])
    return nets.join(rir, ["date", "net", "len"], "left").join(orgs.withColumnsRenamed({"asn": "origin", "org": "isp"}), ["date", "origin"], "left")


def irr_table(objects: DataFrame, blocks: DataFrame, orgs: DataFrame) -> DataFrame:
    """Rows of :func:`netledger.sources.rpsl.route_objects` with ``rir, isp, country``; distinct.

    ``blocks`` are delegations ``date, net, len, rir``, ``orgs`` organisations ``date, asn, org, country``.
    """
    e = _enriched(objects, blocks, orgs)
    return e.select("date", F.col("nro_rir").alias("rir"), F.concat_ws("/", "prefix_addr", F.col("prefix_len").cast("string")).alias("prefix"), "origin", "isp", "country", "source", "changed").distinct()


def vrp_table(rows: DataFrame, blocks: DataFrame, orgs: DataFrame) -> DataFrame:
    """Sound lines of :func:`netledger.sources.roa_lines.parse_roa_lines` with a ``date``: registry from the
    trust anchor in the address, else from the delegated block; organisation and number of addresses."""
    host = F.regexp_extract("uri", "^[a-z]+://([^/]+)", 1)
    anchor = F.coalesce(*[F.when(F.array_contains(F.split(host, "[.]"), k), F.lit(v)) for k, v in ANCHORS.items()])
    e = _enriched(rows, blocks, orgs)
    longest = F.coalesce("max_len", "prefix_len")
    return e.select("date", "uri", "prefix_addr", "prefix_len", longest.alias("max_len"), "origin", F.when(F.col("net.fam") == 4, num_addresses("prefix_len")).alias("num_ip"), "country", F.coalesce(anchor, "nro_rir").alias("rir"), "isp").distinct()


def reduced_updates(updates: DataFrame) -> DataFrame:
    """``date, net, len, origins, total_cnt`` from raw announcements of either family: vantage points per prefix and origin set.

    ``updates`` has one row a vantage point, day, prefix and origin, however many files a day comes in.
    """
    parts = F.transform(F.split(F.regexp_replace("origin", "[{}]", ""), ","), lambda x: asn_to_long(x))
    rows = with_net(updates, "prefix").select("date", "net", "len", F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isNotNull()))).alias("origins"), "vantage").where("size(origins) > 0")
    return rows.groupBy("date", "net", "len", "origins").agg(F.countDistinct("vantage").alias("total_cnt"))


def text_prefix(df: DataFrame) -> DataFrame:
    return df.withColumn("prefix_addr", address_text("net"))
