"""Validity, attribution and relationships of route objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netledger.operators.cover import cover_join

# fixed values: numbers of the operators that scrub attack traffic
SCRUBBERS = (20940, 16625, 32787, 209, 3561, 13335, 19324, 55002, 19551, 3549, 3356, 11213, 10753, 7786, 12008, 19905, 26415, 30060, 200020)
# fixed values: summarised relations, the first that occurs stands
RELATIONS = ("same", "sameISP", "customer-provider", "peering", "ddos", "none")


def validate_origin(routes: DataFrame, payloads: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``validation``: valid if a covering payload has the origin and allows the length,
    invalid if payloads cover but none matches, unknown if none covers. One row per distinct key of ``routes`` comes out."""
    hit = (F.col("origin") == F.col("c_origin")) & (F.col("len") <= F.col("c_max_len"))
    hits = cover_join(routes.select(*keys).distinct(), payloads.select("date", "net", "len", "origin", "max_len"), ["date"], how="left")
    per = hits.groupBy(*keys).agg(F.max(F.when(F.col("c_len").isNotNull(), F.coalesce(hit, F.lit(False)))).alias("hit"))
    state = F.when(F.col("hit"), "valid").when(~F.col("hit"), "invalid").otherwise("unknown")
    return per.select(*keys, state.alias("validation"))


def attribute_rir(routes: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rir``: registry of the shortest covering block; of equal lengths the least name."""
    hits = cover_join(routes, blocks.select("date", "net", "len", "rir"), ["date"])
    return hits.where(F.col("c_rir").isNotNull()).groupBy(*keys).agg(F.min_by("c_rir", F.struct("c_len", "c_rir")).alias("nro_rir"))


def relationship(as1: Column, as2: Column, isp1: Column, isp2: Column, rel: Column) -> Column:
    """Relation of two networks given the edge ``rel`` between them, if any."""
    scrub = as1.isin(*SCRUBBERS) | as2.isin(*SCRUBBERS)
    return F.when(as1 == as2, "same").when(isp1 == isp2, "sameISP").when(rel.isNotNull(), rel).when(scrub, "ddos").otherwise("none")


def directed_edges(rel: DataFrame) -> DataFrame:
    """Edges in both directions; ``rel`` says what as1 is to as2."""
    fwd = rel.select("as1", "as2", F.when(F.col("rel") == -1, "provider").otherwise("peer").alias("rel"))
    back = rel.select(F.col("as2").alias("as1"), F.col("as1").alias("as2"), F.when(F.col("rel") == -1, "customer").otherwise("peer").alias("rel"))
    return fwd.unionByName(back).groupBy("as1", "as2").agg(F.min("rel").alias("rel"))


def rank_of(relation: Column) -> Column:
    """Place of a relation in ``RELATIONS``, provider and customer being one."""
    wide = F.when(relation.isin("provider", "customer"), "customer-provider").when(relation == "peer", "peering").otherwise(relation)
    return F.coalesce(*[F.when(wide == r, F.lit(i)) for i, r in enumerate(RELATIONS)], F.lit(len(RELATIONS) - 1))


def relation_of(rank: Column) -> Column:
    return F.coalesce(*[F.when(rank == i, F.lit(r)) for i, r in enumerate(RELATIONS)])


def _ranked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``_rank``: place of the relation of a route and a covering payload."""
    e = edges.select(F.col("as1").alias("e1"), F.col("as2").alias("e2"), "rel")
    met = pairs.join(e, (F.col("origin") == F.col("e1")) & (F.col("c_origin") == F.col("e2")), "left")
    return met.withColumn("_rank", rank_of(relationship(F.col("origin"), F.col("c_origin"), F.col("isp"), F.col("c_isp"), F.col("rel"))))


def validated_relations(routes: DataFrame, payloads: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, validation, sum_rel`` of one pass over the payloads that cover each route.

    Validity as in :func:`validate_origin`; ``sum_rel`` is the most telling relation to the payloads that
    also allow the length, ``not-covered`` if there is none. Null organisations equal nothing. One row per
    distinct key; routes that nothing covers take part in no join but the first.
    """
    base = routes.select(*keys).distinct()
    pairs = cover_join(base, payloads.select("date", "net", "len", "origin", "max_len", "isp"), ["date"], how="left")
    fits = F.col("len") <= F.col("c_max_len")
    per = _ranked(pairs, edges).groupBy(*keys).agg(
        F.max(F.col("c_len").isNotNull()).alias("covered"), F.max(F.coalesce(fits & (F.col("origin") == F.col("c_origin")), F.lit(False))).alias("hit"), F.min(F.when(fits, F.col("_rank"))).alias("rank")
    )
    state = F.when(~F.col("covered"), "unknown").when(F.col("hit"), "valid").otherwise("invalid")
    return per.select(*keys, state.alias("validation"), F.coalesce(relation_of(F.col("rank")), F.lit("not-covered")).alias("sum_rel"))
