"""Queries of the data-preparation problems that belong to the core (1, 3, 4, 5, 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netledger.functions.ip import with_net
from netledger.operators import intervals as iv
from netledger.operators.cover import cover_join
from netledger.operators.event_time import attributes_as_of, change_history
from netledger.operators.skew import heavy_keys, per_key_profile
from netledger.operators.snapshot_diff import snapshot_changes
from netledger.plans.inputs import bits_of_hex, hex_text
from netledger.session import cut, micros, micros_text, table
from netledger.sources.roa_lines import parse_roa_lines

COLLECTION_END = "2023-04-01 00:00:00"


def _announced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    bgp = table(spark, sf_dir, "bgp_update")
    end = F.coalesce(F.col("ts_end").cast("timestamp"), F.lit(COLLECTION_END).cast("timestamp"))
    return iv.disjoint_spans(bgp.select("nlri", micros("ts").alias("lo"), F.unix_micros(end).alias("hi")), "nlri", "lo", "hi")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, cut_up = _announced(spark, sf_dir)
    spans = iv.gaps(lists, cut_up).select(
        F.lit("bgp_update").alias("table_name"), "entity", micros_text("gap_lo").alias("gap_from"), micros_text("gap_hi").alias("gap_to")
    )
    days = iv.gaps(iv.disjoint_offsets(table(spark, sf_dir, "bgp_feature"), "feat_id", "updays", 0, 364)).select(
        F.lit("bgp_feature").alias("table_name"),
        "entity",
        F.col("gap_lo").cast("string").alias("gap_from"),
        (F.col("gap_hi") - 1).cast("string").alias("gap_to"),
    )
    return spans.unionByName(days)


def p1_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, cut_up = _announced(spark, sf_dir)
    spans = iv.periods(lists, cut_up).select(
        F.lit("bgp_update").alias("table_name"), "entity", micros_text("lo").alias("period_from"), micros_text("hi").alias("period_to")
    )
    days = iv.periods(iv.disjoint_offsets(table(spark, sf_dir, "bgp_feature"), "feat_id", "updays", 0, 364)).select(
        F.lit("bgp_feature").alias("table_name"), "entity", F.col("lo").cast("string").alias("period_from"), (F.col("hi") - 1).cast("string").alias("period_to")
    )
    return spans.unionByName(days)


def _validation_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored_irr rows ``(rec_id, written, as_of)``."""
    day = lambda c: F.unix_date(F.col(c)).cast("long")
    scored = table(spark, sf_dir, "scored_irr").select(
        "rec_id", day("date").alias("at_valid"), micros("scored_at").alias("at_known"), "prefix", F.col("origin").alias("rec_origin"), F.col("validation").alias("written")
    ).distinct()
    vrp = table(spark, sf_dir, "vrp")
    roas = vrp.select("uri", F.concat_ws("/", "prefix_addr", F.col("prefix_len").cast("string")).alias("p")).distinct()
    roas = with_net(roas, "p").select("uri", "net", "len")
    probes = with_net(scored.drop("written"), "prefix").drop("prefix")
    candidates = cover_join(probes, roas, default_route=True, measured=True)
    candidates = candidates.select("rec_id", "at_valid", "at_known", "rec_origin", F.col("len").alias("rec_len"), F.col("c_uri").alias("uri"), F.col("c_len").alias("roa_len"))
    candidates = cut(candidates, "as-of-candidates")  # read twice: for hot keys and for the match
    histories = {
        "vrp_origin": change_history(vrp, "uri", day("date"), micros("known_at"), "origin", "vrp_origin"),
        "vrp_max_len": change_history(vrp, "uri", day("date"), micros("known_at"), "max_len", "vrp_max_len"),
    }
    matched = attributes_as_of(
        candidates, histories, key="uri", valid_us="at_valid", known_us="at_known", types={"vrp_origin": "long", "vrp_max_len": "int"},
        payload=["rec_id", "at_valid", "at_known", "rec_origin", "rec_len", "roa_len"],
    )
    matched = matched.withColumnsRenamed({"at_valid": "m_valid", "at_known": "m_known"})
    hit = F.col("vrp_origin_found") & (F.col("vrp_origin") == F.col("rec_origin")) & (F.col("rec_len") <= F.coalesce("vrp_max_len", "roa_len"))
    per = matched.where("vrp_origin_found").groupBy("rec_id", "m_valid", "m_known", "rec_origin").agg(F.max(F.coalesce(hit, F.lit(False))).alias("valid"))
    per = per.withColumnsRenamed({"rec_id": "m_rec", "rec_origin": "m_origin"})
    on = (F.col("rec_id") == F.col("m_rec")) & (F.col("at_valid") == F.col("m_valid")) & (F.col("at_known") == F.col("m_known")) & F.col("rec_origin").eqNullSafe(F.col("m_origin"))
    as_of = F.when(F.col("valid"), "valid").when(~F.col("valid"), "invalid").otherwise("unknown")
    return scored.join(per, on, "left").select("rec_id", "written", as_of.alias("as_of"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _validation_as_of(spark, sf_dir)
    return v.where(F.col("written").isNotNull() & (F.col("written") != F.col("as_of"))).select("rec_id").distinct()


def p3_validation_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validation_as_of(spark, sf_dir).select("rec_id", F.col("as_of").alias("validation_as_of")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_roa_lines(table(spark, sf_dir, "roa_raw")).where(F.col("reason").isNotNull()).select("line_id", "reason")


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_roa_lines(table(spark, sf_dir, "roa_raw")).where(F.col("reason").isNull()).drop("reason", "error_offset")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda t, c, share: heavy_keys(table(spark, sf_dir, t), c, share).select(
        F.lit(c).alias("field_name"), F.col(c).alias("key_value")
    )
    return pick("bgp_update", "origin", 0.02).unionByName(pick("irr", "source", 0.05))


def p5_origin_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_key_profile(table(spark, sf_dir, "bgp_update"), "origin", distinct={"n_prefixes": "nlri", "n_days": "date"})


def p5_source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_key_profile(table(spark, sf_dir, "irr"), "source", distinct={"n_prefixes": "prefix", "n_days": "date"})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshot_changes(
        table(spark, sf_dir, "irr"), source="source", snapshot="date", key=["source", "prefix", "origin"],
        values=["rir", "isp", "country", "changed"], latest="loaded_at",
    )
    return changes.select(F.date_format("date", "yyyy-MM-dd").alias("snap_date"), "source", "prefix", "origin", "change_kind")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_periods, p3_found, p3_validation_as_of, p4_found, p4_rows, p5_found, p5_origin_profile, p5_source_profile, p6_found)
}

_SPANS = f"""spans AS (SELECT nlri AS e, epoch_us(ts) AS lo, epoch_us(coalesce(ts_end, TIMESTAMP '{COLLECTION_END}')) AS hi
  FROM bgp_update WHERE nlri IS NOT NULL AND coalesce(ts_end, TIMESTAMP '{COLLECTION_END}') > ts),
offs AS (SELECT DISTINCT CAST(feat_id AS VARCHAR) AS e, d FROM (SELECT feat_id, unnest(updays) AS d FROM bgp_feature) WHERE d BETWEEN 0 AND 364)"""

def _bits(addr: str) -> str:
    return bits_of_hex(hex_text(addr))


_AS_OF = f"""rec AS (SELECT *, {_bits("split_part(prefix, '/', 1)")} AS b, CAST(split_part(prefix, '/', 2) AS INT) AS plen
  FROM (SELECT DISTINCT rec_id, date, scored_at, prefix, origin, validation FROM scored_irr)),
roa AS (SELECT *, {_bits("prefix_addr")} AS b FROM vrp),
applied AS (SELECT s.rec_id, s.plen, s.origin, s.validation, v.uri,
    arg_max(struct_pack(o := v.origin, m := coalesce(v.max_len, v.prefix_len)), struct_pack(a := v.date, k := v.known_at)) AS ver
  FROM rec s JOIN roa v ON v.date <= s.date AND v.known_at <= s.scored_at AND v.prefix_len <= s.plen
   AND length(v.b) = length(s.b) AND substr(s.b, 1, v.prefix_len) = substr(v.b, 1, v.prefix_len)
  GROUP BY ALL),
verdict AS (SELECT rec_id, CASE WHEN bool_or(coalesce(ver.o = origin AND plen <= ver.m, false)) THEN 'valid' ELSE 'invalid' END AS got
  FROM applied GROUP BY rec_id),
judged AS (SELECT r.rec_id, r.validation, coalesce(v.got, 'unknown') AS got FROM rec r LEFT JOIN verdict v USING (rec_id))"""

_FIELD = """(?:"(?:[^"]|"")*"|[^",][^",]*|)"""
_PARSED = f"""lines AS (SELECT line_id, raw_line AS r FROM roa_raw WHERE trim(raw_line) <> ''
    AND NOT starts_with(raw_line, '#') AND NOT starts_with(raw_line, '%') AND NOT starts_with(raw_line, 'URI,')),
cells AS (SELECT line_id, r, regexp_full_match(r, '{_FIELD}(,{_FIELD})*') AS quoted_well,
    list_transform(regexp_extract_all(r || ',', '("(?:[^"]|"")*"|[^",]*),', 1),
      lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE trim(x) END) AS c FROM lines),
named AS (SELECT line_id, quoted_well, len(c) AS n, c[1] AS uri, c[2] AS a, c[3] AS p, c[4] AS m, c[5] AS since, c[6] AS until,
    regexp_replace(c[2], '^[aA][sS]', '') AS num, split_part(c[3], '/', 1) AS addr, split_part(c[3], '/', 2) AS plen FROM cells),
typed AS (SELECT *, CASE WHEN regexp_full_match(num, '[0-9]+') THEN TRY_CAST(num AS BIGINT)
      WHEN regexp_full_match(num, '[0-9]+[.][0-9]+') AND TRY_CAST(split_part(num, '.', 1) AS BIGINT) <= 65535 AND TRY_CAST(split_part(num, '.', 2) AS BIGINT) <= 65535
      THEN TRY_CAST(split_part(num, '.', 1) AS BIGINT) * 65536 + TRY_CAST(split_part(num, '.', 2) AS BIGINT) END AS o,
    CASE WHEN contains(addr, ':') THEN 128 ELSE 32 END AS w, TRY_CAST(plen AS INT) AS l,
    regexp_full_match(addr, '((0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])[.]){{3}}(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])')
      OR regexp_full_match(addr, '([0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}')
      OR (regexp_full_match(addr, '([0-9a-fA-F]{{1,4}}(:[0-9a-fA-F]{{1,4}})*)?::([0-9a-fA-F]{{1,4}}(:[0-9a-fA-F]{{1,4}})*)?')
        AND len(list_filter(string_split(addr, ':'), lambda x: x <> '')) <= 7) AS addr_well FROM named),
judged AS (SELECT *, CASE WHEN NOT quoted_well THEN 'quoting' WHEN n <> 6 THEN 'column_count'
    WHEN o IS NULL OR o > 4294967295 THEN 'origin'
    WHEN NOT addr_well OR NOT regexp_full_match(p, '[^/]*/[0-9]+') OR l IS NULL OR l > w OR contains(substr({_bits("addr")}, l + 1), '1') THEN 'prefix'
    WHEN m NOT IN ('', 'None') AND (NOT regexp_full_match(m, '[0-9]+') OR coalesce(TRY_CAST(m AS BIGINT), 999) NOT BETWEEN l AND w) THEN 'max_len' END AS reason FROM typed)"""

ORACLE = {
    "p1_found": f"""WITH {_SPANS},
run AS (SELECT e, lo, max(hi) OVER (PARTITION BY e ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
nxt AS (SELECT e, d, lead(d) OVER (PARTITION BY e ORDER BY d) AS n FROM offs)
SELECT 'bgp_update' AS table_name, e AS entity, strftime(make_timestamp(reach), '%Y-%m-%d %H:%M:%S') AS gap_from, strftime(make_timestamp(lo), '%Y-%m-%d %H:%M:%S') AS gap_to
FROM run WHERE reach < lo
UNION ALL SELECT 'bgp_feature', e, CAST(d + 1 AS VARCHAR), CAST(n - 1 AS VARCHAR) FROM nxt WHERE n > d + 1""",
    "p1_periods": f"""WITH {_SPANS},
run AS (SELECT e, lo, hi, max(hi) OVER (PARTITION BY e ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
isl AS (SELECT e, lo, hi, sum(CASE WHEN reach >= lo THEN 0 ELSE 1 END) OVER (PARTITION BY e ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM run),
days AS (SELECT e, d, d - row_number() OVER (PARTITION BY e ORDER BY d) AS g FROM offs)
SELECT 'bgp_update' AS table_name, e AS entity, strftime(make_timestamp(min(lo)), '%Y-%m-%d %H:%M:%S') AS period_from, strftime(make_timestamp(max(hi)), '%Y-%m-%d %H:%M:%S') AS period_to
FROM isl GROUP BY e, g
UNION ALL SELECT 'bgp_feature', e, CAST(min(d) AS VARCHAR), CAST(max(d) AS VARCHAR) FROM days GROUP BY e, g""",
    "p3_found": f"WITH {_AS_OF} SELECT rec_id FROM judged WHERE validation <> got",
    "p3_validation_as_of": f"WITH {_AS_OF} SELECT rec_id, got AS validation_as_of FROM judged",
    "p4_found": f"WITH {_PARSED} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_rows": f"""WITH {_PARSED} SELECT line_id, uri, o AS origin, addr AS prefix_addr, l AS prefix_len,
  CASE WHEN m NOT IN ('', 'None') THEN CAST(m AS INT) END AS max_len, since AS not_before, until AS not_after FROM judged WHERE reason IS NULL""",
    "p5_found": """SELECT 'origin' AS field_name, origin AS key_value FROM bgp_update WHERE origin IS NOT NULL GROUP BY origin
HAVING count(*) >= 0.02 * (SELECT count(*) FROM bgp_update)
UNION ALL SELECT 'source', source FROM irr WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 0.05 * (SELECT count(*) FROM irr)""",
    "p5_origin_profile": "SELECT origin, count(*) AS n_rows, count(DISTINCT nlri) AS n_prefixes, count(DISTINCT date) AS n_days FROM bgp_update WHERE origin IS NOT NULL GROUP BY origin",
    "p5_source_profile": "SELECT source, count(*) AS n_rows, count(DISTINCT prefix) AS n_prefixes, count(DISTINCT date) AS n_days FROM irr WHERE source IS NOT NULL GROUP BY source",
    "p6_found": """WITH one AS (SELECT DISTINCT date, source, prefix, origin, rir, isp, country, changed FROM irr),
snaps AS (SELECT source, date, lag(date) OVER (PARTITION BY source ORDER BY date) AS before FROM (SELECT DISTINCT source, date FROM irr)),
cur AS (SELECT s.date AS d, s.before, o.* EXCLUDE (date) FROM snaps s JOIN one o ON o.source = s.source AND o.date = s.date WHERE s.before IS NOT NULL),
prev AS (SELECT s.date AS d, o.* EXCLUDE (date) FROM snaps s JOIN one o ON o.source = s.source AND o.date = s.before)
SELECT strftime(coalesce(c.d, p.d), '%Y-%m-%d') AS snap_date, coalesce(c.source, p.source) AS source,
  CASE WHEN c.d IS NULL THEN p.prefix ELSE c.prefix END AS prefix, CASE WHEN c.d IS NULL THEN p.origin ELSE c.origin END AS origin,
  CASE WHEN p.d IS NULL THEN 'added' WHEN c.d IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM cur c FULL JOIN prev p ON c.d = p.d AND c.source = p.source AND c.prefix IS NOT DISTINCT FROM p.prefix AND c.origin IS NOT DISTINCT FROM p.origin
WHERE c.d IS NULL OR p.d IS NULL OR c.rir IS DISTINCT FROM p.rir OR c.isp IS DISTINCT FROM p.isp
  OR c.country IS DISTINCT FROM p.country OR c.changed IS DISTINCT FROM p.changed""",
}
