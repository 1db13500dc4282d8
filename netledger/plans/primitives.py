"""One query for each single operator: filters, functions, joins, aggregates, windows, sets, sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netledger.functions.ip import asn_to_long, bit_text, common_prefix_len, ipv4_to_long, long_to_ipv4, mask4, net_hex, num_addresses, prefix_text
from netledger.functions import bits as bv
from netledger.operators.activity import metric_stats, month_bitmaps, run_metrics, wide_features, year_presence
from netledger.operators.asof import int_day, nearest_snapshot, substitute_days
from netledger.operators.blocks import cidr_blocks, covered_space, number_ranges
from netledger.operators.cover import cover_join
from netledger.operators.registry import attribute_rir
from netledger.operators.scoring import kept, rejection_loss, softplus, y_pred, y_true
from netledger.plans import composites as comp
from netledger.plans import inputs as inp
from netledger.plans import learning
from netledger.session import table
from netledger.sources import delegated
from netledger.sources.rpsl import route_objects
from netledger.sources.transfers import parse_transfers
from netledger.streaming import incremental

SNAPSHOT = 20230331


def _net() -> F.Column:
    return net_hex("net").alias("net")


def p_filter_ipv4_24(s: SparkSession, d: str) -> DataFrame:
    """Announcements of IPv4 no longer than /24."""
    b = inp.bgp(s, d).where((F.col("net.fam") == 4) & inp.not_too_specific())
    return b.select("date", _net(), "len", F.array_join(F.transform("origins", lambda x: x.cast("string")), "|").alias("origins"), "total_cnt")


def p_filter_too_specific(s: SparkSession, d: str) -> DataFrame:
    """Announcements of either family that are not too long to count."""
    return inp.bgp(s, d).where(inp.not_too_specific()).select("date", _net(), "len", F.array_join(F.transform("origins", lambda x: x.cast("string")), "|").alias("origins"), "total_cnt")


def p_irr_trycast(s: SparkSession, d: str) -> DataFrame:
    return inp.irr(s, d).where(F.col("changed").isNotNull()).select("date", _net(), "len", "origin", "source", "changed")


def p_moas_split(s: SparkSession, d: str) -> DataFrame:
    return inp.bgp(s, d).select("date", _net(), "len", F.explode("origins").alias("origin"), "total_cnt")


def p_single_origin(s: SparkSession, d: str) -> DataFrame:
    return inp.shown(comp.routed_single(s, d))


def p_record_type(s: SparkSession, d: str) -> DataFrame:
    v, r = F.col("validation"), F.col("sum_rel")
    kind = F.when(F.col("record_type") == "inactive", "inactive").when((v == "invalid") & (r != "none"), "excluded").when(v.isin("valid", "invalid"), "covered").otherwise("not-covered")
    return inp.scored(s, d).select("idx", y_true("validation").alias("label"), kind.alias("kind"))


def p_reject_filter(s: SparkSession, d: str) -> DataFrame:
    return inp.scored(s, d).where(kept("score0", "score1")).select("idx")


def p_prediction_filter(s: SparkSession, d: str) -> DataFrame:
    return inp.scored(s, d).where((F.col("record_type") != "inactive") & (F.col("validation") == "unknown")).select("idx", _net(), "len", "origin")


def p_active_origins(s: SparkSession, d: str) -> DataFrame:
    """Rows announced on more than four fifths of the newest fortnight."""
    days = inp.presence(s, d).select("feat_id", F.explode("updays").alias("d")).where(F.col("d").between(0, 13)).distinct()
    return days.groupBy("feat_id").agg((F.count(F.lit(1)) / 14).alias("uptime_2weeks")).where("uptime_2weeks > 0.8").select("feat_id", F.round("uptime_2weeks", 6).alias("uptime_2weeks"))


def p_replicate_totals(s: SparkSession, d: str) -> DataFrame:
    totals = inp.vrp(s, d).groupBy("date").agg(F.count(F.lit(1)).alias("total"))
    return totals.withColumn("source", F.explode(F.array(*map(F.lit, (*comp.SOURCES, comp.ALL)))))


def f_prefix_text(s: SparkSession, d: str) -> DataFrame:
    return inp.irr(s, d).select("date", "source", "origin", prefix_text("net", "len").alias("prefix"))


def f_num_ip(s: SparkSession, d: str) -> DataFrame:
    return inp.vrp(s, d).select("date", "uri", num_addresses("len").alias("num_ip"))


def f_binary_prefix(s: SparkSession, d: str) -> DataFrame:
    return inp.irr(s, d).select("net", "len").distinct().select(_net(), "len", bit_text("net", "len").alias("bits"))


def f_common_prefix(s: SparkSession, d: str) -> DataFrame:
    b = inp.derived(s, d, "nro_block").withColumn("stop", F.col("start_ip") + F.col("num_ip") - 1)
    n = b.withColumn("len", common_prefix_len("start_ip", "stop"))
    return n.select("date", "rir", "start_ip", "num_ip", mask4("start_ip", "len").alias("net"), "len")


def f_cidr_expand(s: SparkSession, d: str) -> DataFrame:
    return cidr_blocks(inp.derived(s, d, "nro_block"), "start_ip", "num_ip").select("date", "rir", "start_ip", "net", "len")


def f_asn_expand(s: SparkSession, d: str) -> DataFrame:
    return number_ranges(inp.derived(s, d, "nro_asn"), "asn_start", "num_asn", "asn").select("date", "rir", "asn")


def f_date_diff(s: SparkSession, d: str) -> DataFrame:
    """Days since the last change; -1 without a date, -2 if it is none."""
    days = F.lit(0) + int_day(F.lit(SNAPSHOT)) - int_day("changed")
    return inp.irr(s, d).select("date", "source", _net(), "len", "origin", F.when(F.col("changed").isNull(), -1).otherwise(F.coalesce(days, F.lit(-2))).alias("age"))


def f_softmax(s: SparkSession, d: str) -> DataFrame:
    return inp.scored(s, d).select("idx", F.round(y_pred("record_type", "score0", "score1"), 6).alias("y_pred"))


def f_softplus(s: SparkSession, d: str) -> DataFrame:
    return inp.scored(s, d).where(F.col("score0").isNotNull()).select("idx", F.round(softplus(F.col("score0")), 6).alias("softplus0"))


def f_asdot(s: SparkSession, d: str) -> DataFrame:
    dotted = F.concat(F.lit("AS"), F.expr("origin div 65536").cast("string"), F.lit("."), (F.col("origin") % 65536).cast("string"))
    return inp.irr(s, d).select("origin").distinct().select("origin", dotted.alias("asdot"), asn_to_long(dotted).alias("parsed"))


def f_bit_ops(s: SparkSession, d: str) -> DataFrame:
    b = month_bitmaps(table(s, d, "bgp_update"), ["nlri"], "date").where(F.col("nlri").isNotNull())
    one = F.lit(4).cast("long")
    return b.select(
        "nlri", "month", F.getbit("bits", F.lit(2)).cast("int").alias("tested"), F.col("bits").bitwiseOR(one).alias("set_bit"),
        F.col("bits").bitwiseAND(F.bitwise_not(one)).alias("cleared"), F.col("bits").bitwiseXOR(one).alias("toggled"), F.bit_count("bits").cast("int").alias("n_days"),
    )


def f_month_days(s: SparkSession, d: str) -> DataFrame:
    m = inp.presence(s, d).select("month").distinct()
    first = F.to_date(F.col("month").cast("string"), "yyyyMM")
    ym = lambda c: F.date_format(c, "yyyyMM").cast("int")
    return m.select("month", F.dayofmonth(F.last_day(first)).alias("n_days"), ym(F.add_months(first, 1)).alias("next_month"), ym(F.add_months(first, -1)).alias("last_month"))


def f_rir_names(s: SparkSession, d: str) -> DataFrame:
    c = F.lower("from_rir")
    rir = F.when(c.isin("ripe", "ripe ncc", "ripencc"), "ripencc").when(c == "jpnic", "apnic").when(c.isin("apnic", "arin", "afrinic", "lacnic"), c)
    return table(s, d, "transfer").groupBy("from_rir").agg(F.count(F.lit(1)).alias("n")).select("from_rir", rir.alias("rir"), "n")


def f_date_list(s: SparkSession, d: str) -> DataFrame:
    """Every day between the first and the last snapshot, and whether there is one."""
    days = inp.irr_days(s, d)
    span = days.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("day"))
    return span.join(days.withColumn("has", F.lit(1)), F.col("day") == F.col("date"), "left").select(inp.day_int("day").alias("day"), F.coalesce("has", F.lit(0)).alias("has_snapshot"))


def j_cover(s: SparkSession, d: str) -> DataFrame:
    dim = inp.vrp(s, d).select("date", "net", "len", "max_len", "origin").distinct()
    h = cover_join(inp.bgp(s, d).select("date", "net", "len").distinct(), dim, ["date"], distinct=False)
    return inp.shown(h.select("date", "net", "len", "c_net", "c_len", "c_max_len", "c_origin"))


def j_validate(s: SparkSession, d: str) -> DataFrame:
    return inp.shown(comp.validated_routes(s, d))


def j_rir_attribution(s: SparkSession, d: str) -> DataFrame:
    return inp.shown(attribute_rir(inp.bgp(s, d), inp.delegated(s, d), ["date", "net", "len"]))


def j_as_org(s: SparkSession, d: str) -> DataFrame:
    """Origins of each snapshot day with the organisation of the nearest list."""
    r = inp.irr(s, d).select("date", "origin").distinct()
    orgs = comp.as_org_at(s, d, r.select("date")).withColumnRenamed("asn", "origin")
    return r.join(orgs, ["date", "origin"], "left").select("date", "origin", F.coalesce("org", F.lit("")).alias("org"), F.coalesce("country", F.lit("")).alias("country"))


def j_nearest_snapshot(s: SparkSession, d: str) -> DataFrame:
    return nearest_snapshot(inp.irr(s, d), inp.derived(s, d, "as_org"))


def j_relationship(s: SparkSession, d: str) -> DataFrame:
    return comp.q10_irr_validation(s, d).select("date", "source", "net", "len", "origin", "isp", "sum_rel")


def j_active_inner(s: SparkSession, d: str) -> DataFrame:
    r = inp.irr(s, d).select("date", "source", "net", "len", "origin").distinct()
    return inp.shown(r.join(comp.routed_single(s, d), ["date", "net", "len", "origin"]).withColumn("source", F.explode(F.array("source", F.lit(comp.ALL)))).distinct())


def j_feature_join(s: SparkSession, d: str) -> DataFrame:
    """Route objects with the features of the month before their snapshot."""
    f = table(s, d, "bgp_feature").select(
        F.date_format(F.add_months(F.to_date(F.col("month").cast("string"), "yyyyMM"), 1), "yyyyMM").cast("int").alias("month"),
        F.concat_ws("/", "prefix_addr", F.col("prefix_len").cast("string")).alias("prefix"), "origin", "feat_id", "uptime_30",
    ).distinct()
    r = table(s, d, "irr").select(inp.day_int("date").alias("date"), F.date_format("date", "yyyyMM").cast("int").alias("month"), "source", "prefix", "origin").distinct()
    return r.join(f, ["month", "prefix", "origin"]).select("date", "source", "prefix", "origin", "feat_id", "uptime_30")


def j_full_outer_max(s: SparkSession, d: str) -> DataFrame:
    """Accumulated active objects of all days but the newest, merged with the newest day's."""
    a = comp.active_routes(s, d)
    newest = a.agg(F.max("date")).scalar()
    before = a.where(F.col("date") < newest).groupBy(*comp.AKEY).agg(F.max("date").alias("latest_date"))
    return inp.shown(comp.merge_active(before, a.where(F.col("date") == newest)))


def j_transfer_label(s: SparkSession, d: str) -> DataFrame:
    return comp.q17_transfer_label(s, d).select("idx", "label")


def j_other_active_origin(s: SparkSession, d: str) -> DataFrame:
    return comp.rivals(s, d)


def j_origin_sets_meet(s: SparkSession, d: str) -> DataFrame:
    return comp._prefix_agreement(s, d).select("date", "source", _net(), "len", "same")


def j_totals_left(s: SparkSession, d: str) -> DataFrame:
    """Registered numbers beside delegated ones by day and registry; nothing delegated is 0."""
    r = inp.irr(s, d).groupBy("date", "rir").agg(F.countDistinct("origin").alias("n_asn"))
    t = number_ranges(inp.derived(s, d, "nro_asn"), "asn_start", "num_asn", "asn").groupBy("date", "rir").agg(F.countDistinct("asn").alias("whole"))
    return r.join(t, ["date", "rir"], "left").select("date", "rir", "n_asn", F.coalesce("whole", F.lit(0)).alias("whole"))


def a_count(s: SparkSession, d: str) -> DataFrame:
    return inp.irr(s, d).groupBy("date", "source").agg(F.count(F.lit(1)).alias("n"))


def a_count_distinct(s: SparkSession, d: str) -> DataFrame:
    return inp.irr(s, d).groupBy("date", "source").agg(F.countDistinct("origin").alias("n_origins"), F.countDistinct("net", "len").alias("n_prefixes"))


def a_vector_sum(s: SparkSession, d: str) -> DataFrame:
    v = lambda x: F.sum(F.when(F.col("validation") == x, 1).otherwise(0)).alias(x)
    return comp.validated_routes(s, d).groupBy("date", "source").agg(*map(v, ("valid", "invalid", "unknown")))


def a_vantage_points(s: SparkSession, d: str) -> DataFrame:
    return inp.bgp(s, d).select("date", _net(), "len", F.array_join(F.transform("origins", lambda x: x.cast("string")), "|").alias("origins"), "total_cnt")


def a_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    """Distinct origins by day over {registry, total} x {source, all}, as one set of groupings."""
    r = inp.irr(s, d).withColumn("rir", F.coalesce("rir", F.lit("None")))
    g = s.sql(
        """SELECT date, CASE WHEN grouping(rir) = 1 THEN 'total' ELSE rir END AS rir, CASE WHEN grouping(source) = 1 THEN 'ALL-IRR' ELSE source END AS source,
             count(DISTINCT origin) AS n_asn FROM {r} GROUP BY GROUPING SETS ((date, rir, source), (date, rir), (date, source), (date))""",
        r=r,
    )
    return g


def a_pivot_rir(s: SparkSession, d: str) -> DataFrame:
    g = inp.irr(s, d).groupBy("date", "source").pivot("rir", list(comp.RIRS)).agg(F.countDistinct("origin"))
    return g.na.fill(0)


def a_pivot_relation(s: SparkSession, d: str) -> DataFrame:
    p = comp._prefix_agreement(s, d)
    return p.groupBy("date").agg(F.count(F.lit(1)).alias("overlap"), F.sum("same").alias("same"), F.sum(1 - F.col("same")).alias("discrepant"))


def a_ip_union(s: SparkSession, d: str) -> DataFrame:
    return covered_space(inp.irr(s, d), ["date", "source"])


def a_bitvector(s: SparkSession, d: str) -> DataFrame:
    return month_bitmaps(table(s, d, "bgp_update").where(F.col("nlri").isNotNull() & F.col("origin").isNotNull()), ["nlri", "origin"], "date")


def _rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


def a_run_metrics(s: SparkSession, d: str) -> DataFrame:
    return _rounded(run_metrics(inp.presence(s, d), "feat_id", "updays"), "feat_id", "wnd")


def q15_feature_stats(s: SparkSession, d: str) -> DataFrame:
    m = metric_stats(_rounded(run_metrics(inp.presence(s, d), "feat_id", "updays"), "feat_id", "wnd"), "feat_id")
    return _rounded(m.select("feat_id", *[f"{x}_{y}" for x in ("uptime", "ups", "meanActiveDays", "maxInactiveDays") for y in ("min", "max", "mean", "std")]), "feat_id", digits=8)


def a_percent(s: SparkSession, d: str) -> DataFrame:
    c = comp.q1_bgp_coverage(s, d)
    pct = F.round(F.coalesce(F.try_divide(100 * F.col("valid"), F.col("covered")), F.lit(0.0)), 6)
    return c.select("date", "family", "source", pct.alias("valid_pct"))


def w_active_cdf(s: SparkSession, d: str) -> DataFrame:
    return comp.q12_active_cdf(s, d).select("family", "source", "latest_date", "irr", "irr_total")


def w_age_cdf(s: SparkSession, d: str) -> DataFrame:
    return comp.q13_irr_age_cdf(s, d).where("validation = 'all'").select("date", "source", "age", "cdf")


def w_pr_curve(s: SparkSession, d: str) -> DataFrame:
    return comp.q16_pr_curve(s, d)


def w_auc_pr(s: SparkSession, d: str) -> DataFrame:
    return comp.q16_auc_pr(s, d)


def w_rolling_14d(s: SparkSession, d: str) -> DataFrame:
    """Days, of the fourteen up to each announced day of a prefix, on which it was announced."""
    days = table(s, d, "bgp_update").where(F.col("nlri").isNotNull()).select("nlri", "date").distinct().withColumn("n", F.unix_date("date"))
    back = Window.partitionBy("nlri").orderBy("n").rangeBetween(-13, 0)
    return days.select("nlri", inp.day_int("date").alias("date"), F.count(F.lit(1)).over(back).alias("n_days"))


def w_month_contiguity(s: SparkSession, d: str) -> DataFrame:
    m = inp.presence(s, d).select("month").distinct().withColumn("k", F.expr("month div 100") * 12 + F.col("month") % 100)
    return m.select("month", F.coalesce(F.col("k") - F.lag("k").over(Window.orderBy("k")) == 1, F.lit(True)).cast("int").alias("follows"))


def w_run_islands(s: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive announced days of each prefix."""
    days = table(s, d, "bgp_update").where(F.col("nlri").isNotNull()).select("nlri", "date").distinct()
    island = days.withColumn("g", F.unix_date("date") - F.row_number().over(Window.partitionBy("nlri").orderBy("date")))
    return island.groupBy("nlri", "g").agg(inp.day_int(F.min("date")).alias("first_day"), inp.day_int(F.max("date")).alias("last_day"), F.count(F.lit(1)).alias("n_days")).drop("g")


def _keys(df: DataFrame) -> DataFrame:
    return df.select("date", _net(), "len", "origin")


def u_union(s: SparkSession, d: str) -> DataFrame:
    return _keys(inp.irr(s, d)).unionByName(_keys(inp.vrp(s, d)))


def u_distinct(s: SparkSession, d: str) -> DataFrame:
    return u_union(s, d).distinct()


def u_except(s: SparkSession, d: str) -> DataFrame:
    return _keys(inp.irr(s, d)).subtract(_keys(inp.vrp(s, d)))


def u_intersect(s: SparkSession, d: str) -> DataFrame:
    return _keys(inp.irr(s, d)).intersect(_keys(inp.vrp(s, d)))


def u_dates_missing(s: SparkSession, d: str) -> DataFrame:
    """Days with announcements and without a registry snapshot."""
    have = inp.irr_days(s, d).select(inp.day_int("date").alias("date"))
    return table(s, d, "bgp_update").select(inp.day_int("date").alias("date")).distinct().join(have, "date", "left_anti")


def l_topk(s: SparkSession, d: str) -> DataFrame:
    return p_filter_too_specific(s, d).orderBy(F.desc("total_cnt"), "date", "net", "len", "origins").limit(20)


def l_cover_shortest(s: SparkSession, d: str) -> DataFrame:
    """Shortest payload prefix covering each route object."""
    h = cover_join(inp.irr(s, d).select("date", "net", "len").distinct(), inp.vrp(s, d).select("date", "net", "len").distinct(), ["date"], distinct=False)
    return h.groupBy("date", "net", "len").agg(F.min(F.struct("c_len", "c_net")).alias("m")).select("date", _net(), "len", F.col("m.c_len").alias("c_len"), net_hex("m.c_net").alias("c_net"))


def l_low_watermark(s: SparkSession, d: str) -> DataFrame:
    """First and last day that every input reaches."""
    days = [table(s, d, t).agg(F.min(inp.day_int("date")).alias("lo"), F.max(inp.day_int("date")).alias("hi")) for t in ("irr", "bgp_update", "vrp")]
    one = days[0].unionByName(days[1]).unionByName(days[2])
    return one.agg(F.max("lo").alias("first_day"), F.min("hi").alias("last_day"))


def l_argmax(s: SparkSession, d: str) -> DataFrame:
    """Registry with most valid route objects each day; of equals the first name."""
    v = a_vector_sum(s, d)
    return v.groupBy("date").agg(F.min_by("source", F.struct(-F.col("valid"), F.col("source"))).alias("source"), F.max("valid").alias("valid"))


def s_events_daily(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy(F.date_format(F.col("ts"), "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def q14_bitvector(s: SparkSession, d: str) -> DataFrame:
    """Monthly bitmaps of single-origin announcements."""
    b = table(s, d, "bgp_update").where(F.col("nlri").isNotNull() & F.col("origin").try_cast("long").isNotNull())
    return month_bitmaps(b, ["nlri", "origin"], "date").select("month", "nlri", F.col("origin").cast("long").alias("origin"), "bit_text")


def q15_bgp_feature(s: SparkSession, d: str) -> DataFrame:
    """The 312 features of each row."""
    m = _rounded(run_metrics(inp.presence(s, d), "feat_id", "updays"), "feat_id", "wnd")
    return _rounded(wide_features(m, "feat_id"), "feat_id", digits=8)


def _monthly_bitmaps(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "bgp_update").where(F.col("nlri").isNotNull() & F.col("origin").try_cast("long").isNotNull())
    return month_bitmaps(b, ["nlri", "origin"], "date")


def w_year_presence(s: SparkSession, d: str) -> DataFrame:
    """Twelve monthly bitmaps joined into a year of days, for each month."""
    y = year_presence(_monthly_bitmaps(s, d), ["nlri", "origin"])
    return y.select("nlri", "origin", "month", F.size("updays").alias("n_days"), F.array_min("updays").alias("newest"), F.array_max("updays").alias("oldest"))


def w_year_metrics(s: SparkSession, d: str) -> DataFrame:
    """Run metrics of each prefix and origin by month, from the monthly bitmaps."""
    y = year_presence(_monthly_bitmaps(s, d), ["nlri", "origin"])
    return _rounded(run_metrics(y.select(F.concat_ws(" ", "nlri", "origin", F.col("month").cast("string")).alias("feat_id"), "updays"), "feat_id", "updays"), "feat_id", "wnd")


def p_bitvector_rows(s: SparkSession, d: str) -> DataFrame:
    """Bitvector rows as text, parsed again."""
    line = F.concat_ws("\t", F.col("month").cast("string"), "nlri", "origin", "bit_text")
    f = F.split(F.col("line"), "\t")
    t = q14_bitvector(s, d).select(line.alias("line"))
    return t.select(f[0].cast("int").alias("month"), F.split_part(f[1], F.lit("/"), F.lit(1)).alias("prefix_addr"), F.split_part(f[1], F.lit("/"), F.lit(2)).cast("int").alias("prefix_len"), f[2].cast("long").alias("origin"), bv.from_text(f[3]).alias("bits"))


def p_ancestors(s: SparkSession, d: str) -> DataFrame:
    """Payload prefixes spread over all their ancestors of length 8 and more."""
    v = inp.vrp(s, d).select("uri", "net", "len").distinct()
    each = v.withColumn("alen", F.explode(F.when(F.col("len") >= 8, F.sequence(F.lit(8), F.col("len")))))
    return each.select("uri", "len", "alen", bit_text("net", "alen").alias("bits"))


def p_irr_keyed(s: SparkSession, d: str) -> DataFrame:
    """Route objects for evaluation, under their source and under all."""
    r = inp.irr(s, d).select("date", "source", "net", "len", "origin").withColumn("source", F.explode(F.array("source", F.lit(comp.ALL))))
    return inp.shown(r.distinct())


def f_within_limit(s: SparkSession, d: str) -> DataFrame:
    """Changed within a year before the snapshot; what is no date counts as within."""
    days = int_day("date") - int_day("changed")
    return inp.irr(s, d).select("date", "source", _net(), "len", "origin", "changed", F.coalesce(days <= 365, F.lit(True)).cast("int").alias("within"))


def f_bit_words(s: SparkSession, d: str) -> DataFrame:
    b = q14_bitvector(s, d).withColumn("bits", bv.from_text("bit_text"))
    size = F.length("bit_text")
    return b.select(
        "nlri", "origin", "month", bv.words("bits", 8, 4).alias("words8"), bv.words("bits", 32, 1).alias("words32"), bv.from_words(bv.words("bits", 8, 4), 8).alias("again"),
        bv.shifted("bits", 3, size).alias("later"), bv.shifted("bits", 3, size, 1).alias("later_filled"),
    )


def j_predictions(s: SparkSession, d: str) -> DataFrame:
    """Records with the predictions made for their row ids; records without one go."""
    r = inp.scored(s, d)
    predictions = r.where(F.col("score0").isNotNull() & F.col("score1").isNotNull()).groupBy("idx").agg(F.max_by(F.struct("score0", "score1"), "date").alias("p"))
    return r.select("idx", "date", _net(), "len", "origin").join(predictions, "idx").select("idx", "date", "net", "len", "origin", F.round("p.score0", 6).alias("score0"), F.round("p.score1", 6).alias("score1"))


def _days_of(s: SparkSession, d: str, name: str) -> DataFrame:
    return table(s, d, name).select(inp.day_int("date").alias("date")).where("date is not null")


def u_target_dates(s: SparkSession, d: str) -> DataFrame:
    """Days that any input asks for."""
    return incremental.target_days([_days_of(s, d, t) for t in ("irr", "bgp_update", "vrp")])


def l_date_batches(s: SparkSession, d: str) -> DataFrame:
    """Snapshot days in batches of three."""
    return incremental.day_batches(_days_of(s, d, "irr"), 3)


def i_due_days(s: SparkSession, d: str) -> DataFrame:
    """Days both inputs have, beyond what was done by the middle of February."""
    done = _days_of(s, d, "irr").where("date <= 20230215")
    return incremental.due_days([_days_of(s, d, "irr"), _days_of(s, d, "bgp_update")], done)


def i_single_input(s: SparkSession, d: str) -> DataFrame:
    return incremental.due_days([_days_of(s, d, "irr")], _days_of(s, d, "irr").where("date <= 20230215"))


def i_due_months(s: SparkSession, d: str) -> DataFrame:
    return incremental.due_months(_days_of(s, d, "bgp_update"), s.createDataFrame([(202301,)], "month int"))


def i_complete_days(s: SparkSession, d: str) -> DataFrame:
    return incremental.complete_days(table(s, d, "bgp_update")).select(inp.day_int("date").alias("date"))


def m_split(s: SparkSession, d: str) -> DataFrame:
    """Labelled records split by label: eight tenths of each train."""
    parts = learning.stratified_split(comp.labelled(s, d).select("idx", "label").distinct(), "idx", "label")
    return parts.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))


def m_folds(s: SparkSession, d: str) -> DataFrame:
    """Labelled records in five folds, each label spread evenly."""
    parts = learning.folds(comp.labelled(s, d).select("idx", "label").distinct(), "idx", "label")
    return parts.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def q20_nro_expand(s: SparkSession, d: str) -> DataFrame:
    """Delegations as lines of statistics, parsed and expanded to prefixes and numbers."""
    b, a = inp.derived(s, d, "nro_block"), inp.derived(s, d, "nro_asn")
    v4 = b.select("date", "rir", F.lit("ipv4").alias("kind"), long_to_ipv4("start_ip").alias("start"), F.col("num_ip").alias("n"))
    asn = a.select("date", "rir", F.lit("asn").alias("kind"), F.col("asn_start").cast("string").alias("start"), F.col("num_asn").alias("n"))
    lines = v4.unionByName(asn).withColumns({"cc": F.lit(None).cast("string"), "registered": F.lit(None).cast("string"), "status": F.lit("allocated")})
    nets = delegated.ipv4_prefixes(lines).select("date", "rir", F.lit("ipv4").alias("kind"), F.concat_ws("/", long_to_ipv4("net"), F.col("len").cast("string")).alias("resource"))
    return nets.unionByName(delegated.numbers(lines).select("date", "rir", F.lit("asn").alias("kind"), F.col("asn").cast("string").alias("resource")))


def q21_transfers_flatten(s: SparkSession, d: str) -> DataFrame:
    """Transfers as nested logs, flattened again."""
    t = table(s, d, "transfer").where(~F.col("prefix_addr").contains(":"))
    start = ipv4_to_long("prefix_addr")
    ends = F.array(F.struct(F.col("prefix_addr").alias("start_address"), long_to_ipv4(start + num_addresses("prefix_len") - 1).alias("end_address")))
    org = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("name")))
    log = F.struct(
        F.col("transfer_type").alias("type"), F.date_format("date", "yyyy-MM-dd'T'00:00:00'Z'").alias("transfer_date"), F.col("from_rir").alias("source_rir"),
        F.col("to_rir").alias("recipient_rir"), org("from_isp").alias("source_organization"), org("to_isp").alias("recipient_organization"), F.array(F.struct(ends.alias("transfer_set"))).alias("ip4nets"),
    )
    return parse_transfers(t.select(F.to_json(log).alias("log")), "log")


def s_rpsl_routes(s: SparkSession, d: str) -> DataFrame:
    """Route objects as registry text, parsed again."""
    t = table(s, d, "irr")
    key = F.when(F.col("prefix").contains(":"), "route6:  ").otherwise("route:   ")
    dated = F.when(F.col("changed").isNotNull(), F.concat(F.lit("changed: x@example "), F.col("changed").cast("string"), F.lit("\nchanged: x@example 19900101\n"))).otherwise("")
    value = F.concat(F.lit("% from a dump\n"), key, "prefix", F.lit("\ndescr:   first\n+ more\norigin:  AS"), F.col("origin").cast("string"), F.lit(" # now\n"), dated, F.lit("source:  "), "source")
    rows = route_objects(t.select(inp.day_int("date").alias("date"), "source", value.alias("value")))
    return rows.select("date", "source", F.concat_ws("/", "prefix_addr", F.col("prefix_len").cast("string")).alias("prefix"), "origin", "changed").distinct()


def f_rejection_loss(s: SparkSession, d: str) -> DataFrame:
    r = comp.labelled(s, d)
    return r.select("idx", F.round(rejection_loss("label", "score0", "score1", 0.6), 6).alias("loss"))


def j_substitute_days(s: SparkSession, d: str) -> DataFrame:
    """For each announced day and registry the snapshot that serves it: its own, or the next one."""
    snaps = table(s, d, "irr").select("source", "date").distinct()
    before = F.lag("date").over(Window.partitionBy("source").orderBy("date"))
    gaps = snaps.select("source", F.date_add(before, 1).alias("gap_from"), F.col("date").alias("gap_to")).where("gap_from is not null and gap_from < gap_to")
    reach = snaps.groupBy("source").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = table(s, d, "bgp_update").agg(F.collect_set("date")).scalar()  # one value a day
    wanted = reach.withColumn("days", days).select("source", F.explode(F.filter("days", lambda x: x.between(F.col("a"), F.col("b")))).alias("date"))
    out = substitute_days(wanted, gaps, ["source"])
    return out.select("source", inp.day_int("date").alias("date"), inp.day_int("use_date").alias("use_date"))


_EXTRA = (q14_bitvector, q15_bgp_feature, q15_feature_stats, q20_nro_expand, q21_transfers_flatten)
QUERIES = {n: f for n, f in list(globals().items()) if n[:2] in ("p_", "f_", "j_", "a_", "w_", "u_", "l_", "s_", "i_", "m_") and callable(f) and n != "f_"} | {f.__name__: f for f in _EXTRA}
