"""The composite queries: coverage, consistency, overlap, activity, evaluation, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netledger.functions.ip import net_hex
from netledger.operators.asof import int_day, nearest_snapshot
from netledger.operators.blocks import covered_space, number_ranges
from netledger.operators.cover import cover_join
from netledger.operators.registry import attribute_rir, directed_edges, validate_origin, validated_relations
from netledger.operators.scoring import auc_pr, kept, pr_curve, softmax1, y_pred, y_true
from netledger.plans import inputs as inp
from netledger.session import cut

# fixed values: registries reported one by one
SOURCES = ("AFRINIC", "APNIC", "ARIN", "LACNIC", "RIPE", "RADB")
RIRS = ("ripencc", "apnic", "arin", "afrinic", "lacnic")
ALL = "ALL-IRR"
THRESHOLD = 0.01
LOOK_BACK = 14
BKEY = ["date", "net", "len", "origins"]


def routed(spark: SparkSession, d: str) -> DataFrame:
    """Announcements no longer than /24 or /48 on days with a registry snapshot; ``origin`` is null for several origins."""
    days = inp.irr_days(spark, d).select(inp.day_int("date").alias("date"))
    b = inp.bgp(spark, d).where(inp.not_too_specific()).join(F.broadcast(days), "date", "left_semi")
    return b.withColumn("origin", F.when(F.size("origins") == 1, F.element_at("origins", 1)))


def _family() -> F.Column:
    return F.col("net.fam").alias("family")


def _dim(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("date", "net", "len", *cols).distinct()


def _flags(b: DataFrame, dim: DataFrame, valid: F.Column, *group: str) -> DataFrame:
    """Covered announcements with whether any covering record is valid."""
    hits = cover_join(b, dim, ["date"], distinct=False)
    return hits.groupBy(*BKEY, *group).agg(F.max(F.coalesce(valid, F.lit(False)).cast("int")).alias("valid"))


def q1_bgp_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Announcements covered and confirmed by payloads and by each registry, by day and family."""
    b = routed(spark, d)
    same = F.col("origin") == F.col("c_origin")
    by_vrp = _flags(b, _dim(inp.vrp(spark, d), "origin", "max_len"), same & (F.col("len") <= F.col("c_max_len"))).withColumn("source", F.lit("VRP"))
    routes = _dim(inp.irr(spark, d).where(F.col("changed").isNotNull()), "origin", "source")
    by_irr = _flags(b, routes, same, "c_source").withColumnRenamed("c_source", "source")
    every = by_irr.groupBy(*BKEY).agg(F.max("valid").alias("valid")).withColumn("source", F.lit(ALL))
    flagged = by_vrp.unionByName(by_irr.where(F.col("source").isin(*SOURCES))).unionByName(every)
    counts = flagged.groupBy("date", _family(), "source").agg(F.count(F.lit(1)).alias("covered"), F.sum("valid").alias("valid"))
    totals = b.groupBy("date", _family()).agg(F.count(F.lit(1)).alias("total")).withColumn("source", F.explode(F.array(*map(F.lit, ("VRP", *SOURCES, ALL)))))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return totals.join(counts, ["date", "family", "source"], "left").select("date", "family", F.lit("total").alias("rir"), "source", "total", zero("covered"), zero("valid"))


def q2_inconsistent_bgp(spark: SparkSession, d: str) -> DataFrame:
    """Announcements that payloads and registries both cover, and whether both confirm them or neither does.

    One pass: payloads and route objects are one dimension, told apart by whether they limit the length.
    """
    b = routed(spark, d)
    routes = _dim(inp.irr(spark, d).where(F.col("changed").isNotNull()), "origin").withColumn("max_len", F.lit(None).cast("int"))
    both = cover_join(b, _dim(inp.vrp(spark, d), "origin", "max_len").unionByName(routes), ["date"], distinct=False)
    roa, same = F.col("c_max_len").isNotNull(), F.col("origin") == F.col("c_origin")
    hit = lambda kind, ok: F.max(F.when(kind, F.coalesce(ok, F.lit(False))))
    per = both.groupBy(*BKEY).agg(hit(roa, same & (F.col("len") <= F.col("c_max_len"))).alias("by_vrp"), hit(~roa, same).alias("by_irr")).where("by_vrp is not null and by_irr is not null")
    per = per.withColumn("consistent", ((F.size("origins") > 1) | (F.col("by_vrp") == F.col("by_irr"))).cast("long"))
    found = per.groupBy("date", _family()).agg(F.count(F.lit(1)).alias("both_covered"), F.sum("consistent").alias("consistent"))
    totals = b.groupBy("date", _family()).agg(F.count(F.lit(1)).alias("total"))
    n, c = F.coalesce("both_covered", F.lit(0)), F.coalesce("consistent", F.lit(0))
    return totals.join(found, ["date", "family"], "left").select("date", "family", "total", n.alias("both_covered"), c.alias("consistent"), (n - c).alias("discrepant"))


def _prefix_agreement(spark: SparkSession, d: str) -> DataFrame:
    """(date, source, net, len, same) of registered prefixes covered by payloads."""
    routes = inp.irr(spark, d).select("date", "source", "net", "len", "origin").distinct()
    hits = cover_join(routes, _dim(inp.vrp(spark, d), "origin"), ["date"], distinct=False)
    return hits.groupBy("date", "source", "net", "len").agg(F.max((F.col("origin") == F.col("c_origin")).cast("long")).alias("same"))


def q3_inconsistent_prefix(spark: SparkSession, d: str) -> DataFrame:
    per = _prefix_agreement(spark, d)
    both = per.withColumn("source", F.explode(F.array("source", F.lit(ALL))))
    return both.groupBy("date", _family(), "source").agg(
        F.count(F.lit(1)).alias("overlap"), F.sum("same").alias("same"), (F.count(F.lit(1)) - F.sum("same")).alias("discrepant")
    )


def _fan(df: DataFrame, rir: F.Column, source: F.Column | None) -> DataFrame:
    """Each row under its registry and 'total', and under its source and all sources."""
    out = df.withColumn("rir", F.explode(F.array(F.coalesce(rir, F.lit("None")), F.lit("total"))))
    return out.withColumn("source", F.explode(F.array(source, F.lit(ALL))) if source is not None else F.lit("VRP"))


def _by_rir(found: DataFrame, totals: DataFrame, value: str) -> DataFrame:
    """Seven columns of counts and totals, zero where there is none."""
    by = ["date", "rir", *(["family"] if "family" in totals.columns else [])]
    joined = found.join(totals, by, "left")
    cols = []
    for r in ("total", *RIRS, "None"):
        here = F.col("rir") == r
        cols += [F.coalesce(F.max(F.when(here, F.col(value))), F.lit(0)).alias(f"{r}_cnt"), F.coalesce(F.max(F.when(here, F.col("whole"))), F.lit(0)).alias(f"{r}_total")]
    return joined.groupBy("date", "family", "source").agg(*cols)


def q4_ip_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Registered space beside delegated space: IPv4 addresses, IPv6 networks of length 64."""
    i = _fan(inp.irr(spark, d).select("date", "rir", "source", "net", "len"), F.col("rir"), F.col("source"))
    v = _fan(inp.vrp(spark, d).select("date", "rir", "net", "len"), F.col("rir"), None)
    found = covered_space(i.unionByName(v), ["date", "source", "rir"])
    n = inp.delegated(spark, d).withColumn("rir", F.explode(F.array("rir", F.lit("total"))))
    totals = covered_space(n, ["date", "rir"]).withColumnRenamed("num_ip", "whole")
    return _by_rir(found, totals, "num_ip")


def q5_as_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Origins registered with prefixes of either family beside delegated numbers."""
    i = _fan(inp.irr(spark, d).select("date", "rir", "source", _family(), "origin").distinct(), F.col("rir"), F.col("source"))
    v = _fan(inp.vrp(spark, d).select("date", "rir", _family(), "origin").distinct(), F.col("rir"), None)
    found = i.unionByName(v).groupBy("date", "source", "rir", "family").agg(F.countDistinct("origin").alias("n_asn"))
    asn = number_ranges(inp.derived(spark, d, "nro_asn"), "asn_start", "num_asn", "asn")
    rir = F.when(F.col("rir") == "jpnic", "apnic").otherwise(F.col("rir"))
    totals = asn.withColumn("rir", F.explode(F.array(rir, F.lit("total")))).groupBy("date", "rir").agg(F.countDistinct("asn").alias("whole"))
    return _by_rir(found, totals, "n_asn")


def q6_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes in both kinds of registry beside each kind's records, by day and source."""
    routes = inp.irr(spark, d).select("date", "source", "net", "len", "origin").distinct()
    roas = inp.vrp(spark, d).select("date", "uri", "net", "len", "origin").distinct()
    hits = cover_join(routes, roas, ["date"], distinct=False).withColumn("source", F.explode(F.array("source", F.lit(ALL))))
    prefix = F.struct("net", "len")
    both = hits.groupBy("date", _family(), "source").agg(
        F.countDistinct(prefix).alias("both_covered"), F.countDistinct("c_uri").alias("roa_both"), F.countDistinct(F.struct("net", "len", "origin")).alias("irr_both")
    )
    irr_total = routes.withColumn("source", F.explode(F.array("source", F.lit(ALL)))).groupBy("date", _family(), "source").agg(F.countDistinct(F.struct("net", "len", "origin")).alias("irr_total"))
    roa_total = roas.groupBy("date", _family()).agg(F.countDistinct("uri").alias("roa_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return irr_total.join(roa_total, ["date", "family"], "left").join(both, ["date", "family", "source"], "left").select(
        "date", "family", "source", *[zero(c) for c in ("both_covered", "roa_both", "roa_total", "irr_both", "irr_total")]
    )


def scored_methods(spark: SparkSession, d: str) -> DataFrame:
    """Scored records with truth, probability and the methods that keep them."""
    s = inp.scored(spark, d).withColumns({"yt": y_true("validation"), "yp": y_pred("record_type", "score0", "score1")})
    ml = F.coalesce(((F.col("yt") == 1) | (F.col("yp") > 0)) & (F.col("yp") >= THRESHOLD), F.lit(False))
    named = F.array(F.lit("IRR"), F.when(F.col("yt") != 0, F.lit("IRRd4")), F.when(ml, F.lit("IRR-ML")))
    return s.withColumn("method", F.explode(F.filter(named, lambda x: x.isNotNull())))


def q7_eval_bgp_coverage(spark: SparkSession, d: str) -> DataFrame:
    days = inp.scored(spark, d).select("date").distinct()
    b = inp.bgp(spark, d).where(inp.not_too_specific()).join(F.broadcast(days), "date", "left_semi")
    b = b.withColumn("origin", F.when(F.size("origins") == 1, F.element_at("origins", 1)))
    s = scored_methods(spark, d).withColumn("source", F.explode(F.array("source", F.lit(ALL))))
    per = _flags(b, _dim(s, "origin", "source", "method"), F.col("origin") == F.col("c_origin"), "c_source", "c_method")
    counts = per.groupBy(_family(), F.col("c_source").alias("source"), F.col("c_method").alias("method")).agg(F.count(F.lit(1)).alias("covered"), F.sum("valid").alias("valid"))
    totals = b.groupBy(_family()).agg(F.count(F.lit(1)).alias("total"))  # two rows
    return counts.join(F.broadcast(totals), "family").select("family", "source", "method", "total", "covered", "valid")


def q8_eval_active(spark: SparkSession, d: str) -> DataFrame:
    """Scored records with an announcement inside them by their origin alone within ``LOOK_BACK`` days up to the record's.

    Days are cut into buckets of that length; a record looks in its own bucket and the one before, so no
    other days meet it.
    """
    s = scored_methods(spark, d).where(F.col("origin").isNotNull())
    bucket = lambda c: F.floor(int_day(c) / LOOK_BACK)
    b = inp.bgp(spark, d).where(inp.not_too_specific() & (F.size("origins") == 1)).select("net", "len", F.element_at("origins", 1).alias("origin"), F.col("date").alias("seen")).distinct()
    dim = s.select("net", "len", "origin", "date", "source", "method").distinct().withColumn("bucket", F.explode(F.array(bucket("date"), bucket("date") - 1)))
    hits = cover_join(b.withColumn("bucket", bucket("seen")), dim, ["origin", "bucket"], distinct=False)
    gap = int_day("c_date") - int_day("seen")
    active = hits.where(gap.between(0, LOOK_BACK - 1)).groupBy(_family(), F.col("c_source").alias("source"), F.col("c_method").alias("method")).agg(
        F.countDistinct(F.struct("c_net", "c_len", "origin")).alias("active_cnt")
    )
    # the total of the learned method also keeps every record known to be valid
    more = s.where((F.col("method") == "IRR") & (F.col("yt") == 1)).withColumn("method", F.lit("IRR-ML"))
    totals = s.unionByName(more).groupBy(_family(), "source", "method").agg(
        F.countDistinct(F.struct("net", "len", "origin")).alias("total_cnt"), F.countDistinct(F.struct("net", "len")).alias("total_prefix_cnt")
    )
    return totals.join(active, ["family", "source", "method"], "left").select("family", "source", "method", F.coalesce("active_cnt", F.lit(0)).alias("active_cnt"), "total_cnt", "total_prefix_cnt")


def as_org_at(spark: SparkSession, d: str, days: DataFrame) -> DataFrame:
    """Organisations of the snapshot nearest to each day: date, asn, org, country."""
    orgs = inp.derived(spark, d, "as_org")
    near = nearest_snapshot(days, orgs)
    return orgs.join(F.broadcast(near), "snapshot").select("date", "asn", "org", "country")


def q9_reduce_bgp(spark: SparkSession, d: str) -> DataFrame:
    """Announcements with registry and, for each origin in order, organisation and country."""
    days = inp.irr_days(spark, d).select(inp.day_int("date").alias("date"))
    b = inp.bgp(spark, d).join(F.broadcast(days), "date", "left_semi")
    rir = attribute_rir(b, inp.delegated(spark, d), ["date", "net", "len"])
    each = b.select("date", "net", "len", "origins", "total_cnt", F.posexplode("origins").alias("pos", "asn")).join(as_org_at(spark, d, days), ["date", "asn"], "left")
    back = each.groupBy("date", "net", "len", "origins", "total_cnt").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("org", F.lit("")).alias("org"), F.coalesce("country", F.lit("")).alias("country")))).alias("a"))
    text = lambda field: F.array_join(F.transform("a", lambda x: x[field]), "|")
    return back.join(rir, ["date", "net", "len"], "left").select(
        "date", F.col("nro_rir").alias("rir"), net_hex("net").alias("net"), "len", F.array_join(F.transform("origins", lambda x: x.cast("string")), "|").alias("origins"),
        text("org").alias("isps"), text("country").alias("countries"), "total_cnt",
    )


RKEY = ["date", "source", "net", "len", "origin", "isp"]


def q10_irr_validation(spark: SparkSession, d: str) -> DataFrame:
    """Route objects with validation and summarised relation to the payloads covering them."""
    edges = directed_edges(inp.derived(spark, d, "as_rel"))
    return inp.shown(validated_relations(inp.irr(spark, d).select(*RKEY), inp.vrp(spark, d), edges, RKEY))


def validated_routes(spark: SparkSession, d: str) -> DataFrame:
    return validate_origin(inp.irr(spark, d).select("date", "source", "net", "len", "origin"), inp.vrp(spark, d), ["date", "source", "net", "len", "origin"])


def active_routes(spark: SparkSession, d: str, validated: DataFrame | None = None) -> DataFrame:
    """Route objects announced exactly, on the day, by their origin alone; also under all registries."""
    validated = validated_routes(spark, d) if validated is None else validated
    found = validated.join(routed_single(spark, d), ["date", "net", "len", "origin"], "left_semi")
    return found.withColumn("source", F.explode(F.array("source", F.lit(ALL)))).distinct()


def q11_active_irr(spark: SparkSession, d: str) -> DataFrame:
    return inp.shown(active_routes(spark, d))


def routed_single(spark: SparkSession, d: str) -> DataFrame:
    b = inp.bgp(spark, d).where(F.size("origins") == 1)
    return b.select("date", "net", "len", F.element_at("origins", 1).alias("origin")).distinct()


AKEY = ["source", "net", "len", "origin", "validation"]


def merge_active(state: DataFrame, day: DataFrame) -> DataFrame:
    """Accumulated ``AKEY, latest_date`` with the active objects ``AKEY, date`` of further days: the latest day of each key.

    Either side may be empty; a day that is merged again changes nothing.
    """
    both = state.select(*AKEY, "latest_date").unionByName(day.select(*AKEY, F.col("date").alias("latest_date")))
    return both.groupBy(*AKEY).agg(F.max("latest_date").alias("latest_date"))


def q12_active_merged(spark: SparkSession, d: str, validated: DataFrame | None = None) -> DataFrame:
    """Active objects by the last day on which each was active with its validation; 'total' has the unknown ones too."""
    a = active_routes(spark, d, validated)
    last = merge_active(a.select(*AKEY, F.col("date").alias("latest_date")).limit(0), a)
    rows = last.select("source", _family(), "latest_date", F.explode(F.array(F.col("validation"), F.lit("total"))).alias("validation")).where("validation <> 'unknown'")
    return rows.groupBy("family", "source", "validation", "latest_date").agg(F.count(F.lit(1)).alias("cnt"))


def registered_totals(spark: SparkSession, d: str, validated: DataFrame) -> DataFrame:
    """``family, source`` and the route objects of the newest snapshot day: all, valid and invalid."""
    newest = inp.irr_days(spark, d).agg(inp.day_int(F.max("date"))).scalar()
    v = validated.where(F.col("date") == newest).withColumn("source", F.explode(F.array("source", F.lit(ALL)))).distinct()
    of = lambda x: F.count(F.when(F.col("validation") == x, 1)).alias(f"{x}_total")
    return v.groupBy(_family(), "source").agg(F.count(F.lit(1)).alias("irr_total"), of("valid"), of("invalid"))


def q12_active_cdf(spark: SparkSession, d: str) -> DataFrame:
    """Objects last active on a day or later beside those registered on the newest day; null where a source has none then."""
    validated = cut(validated_routes(spark, d), "validated")  # used twice
    m = q12_active_merged(spark, d, validated)
    of = lambda v: F.coalesce(F.sum(F.when(F.col("validation") == v, F.col("cnt"))), F.lit(0))
    wide = m.groupBy("family", "source", "latest_date").agg(of("total").alias("irr"), of("valid").alias("valid"), of("invalid").alias("invalid"))
    newest = Window.partitionBy("family", "source").orderBy(F.desc("latest_date")).rowsBetween(Window.unboundedPreceding, 0)
    run = wide.select("family", "source", "latest_date", *[F.sum(c).over(newest).alias(c) for c in ("irr", "valid", "invalid")])
    cols = [x for c in ("irr", "valid", "invalid") for x in (c, f"{c}_total")]
    return run.join(registered_totals(spark, d, validated), ["family", "source"], "left").select("family", "source", "latest_date", *cols)


def q13_irr_age_cdf(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative share of ages in days since the last change, by snapshot day, source (and all) and validation ('all' too)."""
    keys = ["date", "source", "net", "len", "origin", "changed"]
    v = validate_origin(inp.irr(spark, d).select(*keys), inp.vrp(spark, d), keys)
    aged = v.withColumn("age", int_day("date") - int_day("changed")).where(F.col("age").isNotNull())
    each = aged.withColumns({"source": F.explode(F.array("source", F.lit(ALL)))})
    rows = each.select("date", "source", F.explode(F.array(F.lit("all"), "validation")).alias("validation"), "age").where("validation <> 'unknown'")
    freq = rows.groupBy("date", "source", "validation", "age").agg(F.count(F.lit(1)).alias("freq"))
    by = ["date", "source", "validation"]
    up = Window.partitionBy(*by).orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    return freq.select(*by, "age", F.round(F.sum("freq").over(up) / F.sum("freq").over(Window.partitionBy(*by)), 9).alias("cdf"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    s = inp.scored(spark, d).withColumn("label", y_true("validation")).where((F.col("label") >= 0) & F.col("score0").isNotNull() & F.col("score1").isNotNull())
    return s.withColumn("p", F.round(softmax1("score0", "score1"), 6))


def q16_pr_curve(spark: SparkSession, d: str) -> DataFrame:
    c = pr_curve(labelled(spark, d).where(kept("score0", "score1")), "label", "p")
    return c.select("threshold", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


def q16_auc_pr(spark: SparkSession, d: str) -> DataFrame:
    s = labelled(spark, d)
    every = auc_pr(pr_curve(s, "label", "p")).select(F.lit("all").alias("records"), F.round("auc_pr", 7).alias("auc_pr"))
    some = auc_pr(pr_curve(s.where(kept("score0", "score1")), "label", "p")).select(F.lit("kept").alias("records"), F.round("auc_pr", 7).alias("auc_pr"))
    return every.unionByName(some)


def rivals(spark: SparkSession, d: str) -> DataFrame:
    """idx of scored records whose exact prefix another origin of another organisation announces."""
    s = inp.scored(spark, d).select("idx", "net", "len", "origin", "isp")
    home = inp.irr(spark, d).where(F.col("isp").isNotNull() & (F.col("isp") != "None")).groupBy("origin").agg(F.min("isp").alias("home"))
    seen = inp.bgp(spark, d).select("net", "len", F.explode("origins").alias("other")).distinct().join(home.withColumnRenamed("origin", "other"), "other", "left")
    met = s.join(seen, ["net", "len"]).where((F.col("other") != F.col("origin")) & ~F.coalesce(F.col("home") == F.col("isp"), F.lit(False)))
    return met.select("idx").distinct()


def q17_transfer_label(spark: SparkSession, d: str) -> DataFrame:
    """First decisive covering transfer, newest first, of records that are neither inactive nor validated."""
    s = inp.scored(spark, d).where((F.col("record_type") != "inactive") & (F.col("validation") == "unknown"))
    s = s.join(rivals(spark, d).withColumn("rival", F.lit(True)), "idx", "left")
    hits = cover_join(s, inp.transfer(spark, d), distinct=False)
    to = F.coalesce(F.col("isp") == F.col("c_to_isp"), F.lit(False))
    left = hits.where(~F.coalesce(F.col("c_from_isp") == F.col("c_to_isp"), F.lit(False)) & ~(to & F.coalesce("rival", F.lit(False))))
    order = Window.partitionBy("idx").orderBy(F.desc("c_date"), F.desc("c_len"), F.col("c_to_isp").asc_nulls_first(), F.col("c_from_isp").asc_nulls_first())
    first = left.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    label = F.when(F.coalesce(F.col("isp") == F.col("c_to_isp"), F.lit(False)), 1).when(F.coalesce(F.col("isp") == F.col("c_from_isp"), F.lit(False)), 0)
    return first.withColumn("label", label).where(F.col("label").isNotNull()).select("idx", F.col("c_date").alias("transferred_date"), F.col("c_from_isp").alias("from_isp"), F.col("c_to_isp").alias("to_isp"), "label")


def q18_prefix_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Records of prefixes with several origins: each one's share of a softmax over the prefix's scores."""
    s = inp.scored(spark, d).where(F.col("score1").isNotNull()).groupBy("date", "net", "len", "origin").agg(F.max("score1").alias("score1"))
    w = Window.partitionBy("date", "net", "len")
    e = s.withColumns({"n_origins": F.count(F.lit(1)).over(w), "e": F.exp(F.col("score1") - F.max("score1").over(w))})
    return e.where("n_origins > 1").select("date", net_hex("net").alias("net"), "len", "origin", "n_origins", F.round(F.col("e") / F.sum("e").over(w), 6).alias("share"))


def q18_origin_counts(spark: SparkSession, d: str) -> DataFrame:
    per = inp.scored(spark, d).groupBy("net", "len").agg(F.countDistinct("origin").alias("n"))
    return per.groupBy(F.when(F.col("n") > 1, "multiple").otherwise("single").alias("kind")).agg(F.count(F.lit(1)).alias("n_prefixes"))


def _shares(c: DataFrame, part: str, whole: str) -> DataFrame:
    """``date, family`` and the percentage of ``part`` in ``whole``, of payloads and of all registries; 0 of nothing."""
    of = lambda source: F.round(F.coalesce(F.try_divide(100.0 * F.max(F.when(F.col("source") == source, F.col(part))), F.max(F.when(F.col("source") == source, F.col(whole)))), F.lit(0.0)), 6)
    return c.groupBy("date", "family").agg(of("VRP").alias("rpki_pct"), of(ALL).alias("irr_pct"))


def _discrepancy(c: DataFrame, whole: str) -> DataFrame:
    pct = F.round(F.coalesce(F.try_divide(100.0 * F.col("discrepant"), F.col(whole)), F.lit(0.0)), 6)
    return c.select("date", "family", pct.alias("irr_pct"), F.col("discrepant").alias("irr_cnt"))


def between(df: DataFrame, start: int, end: int) -> DataFrame:
    """Days after ``start`` up to ``end`` (``yyyymmdd``), as one export holds them."""
    return df.where((F.col("date") > start) & (F.col("date") <= end))


def q19_ip_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _shares(q4_ip_coverage(spark, d), "total_cnt", "total_total")


def q19_as_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _shares(q5_as_coverage(spark, d), "total_cnt", "total_total")


def q19_web_export(spark: SparkSession, d: str) -> DataFrame:
    """Share of announcements covered, by day: payloads and all registries, in percent."""
    return _shares(q1_bgp_coverage(spark, d), "covered", "total")


def q19_bgp_valid(spark: SparkSession, d: str) -> DataFrame:
    return _shares(q1_bgp_coverage(spark, d), "valid", "covered")


def q19_inconsistent_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _discrepancy(q3_inconsistent_prefix(spark, d).where(F.col("source") == ALL), "overlap")


def q19_inconsistent_bgp(spark: SparkSession, d: str) -> DataFrame:
    return _discrepancy(q2_inconsistent_bgp(spark, d), "both_covered")


QUERIES = {
    f.__name__: f
    for f in (
        q1_bgp_coverage, q2_inconsistent_bgp, q3_inconsistent_prefix, q4_ip_coverage, q5_as_coverage, q6_overlap, q7_eval_bgp_coverage, q8_eval_active,
        q9_reduce_bgp, q10_irr_validation, q11_active_irr, q12_active_merged, q12_active_cdf, q13_irr_age_cdf, q16_pr_curve, q16_auc_pr,
        q17_transfer_label, q18_prefix_conflict, q18_origin_counts, q19_ip_coverage, q19_as_coverage, q19_web_export, q19_bgp_valid, q19_inconsistent_prefix, q19_inconsistent_bgp,
    )
}
