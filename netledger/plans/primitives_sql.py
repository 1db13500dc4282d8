"""DuckDB text of the single operators."""

from __future__ import annotations

from netledger.operators.activity import METRICS, WINDOWS
from netledger.plans.composites import ALL, RIRS, SOURCES
from netledger.plans.composites_sql import ORACLE as COMPOSITE
from netledger.plans.composites_sql import ACTIVE, METHODS, Q1, VALIDATED, first_unit, inside, units
from netledger.plans.inputs import bits_of_hex, hex_text, with_inputs
from netledger.plans.primitives import SNAPSHOT

_DAY = "CAST(strftime(date, '%Y%m%d') AS INT)"
_O = "array_to_string(origins, '|') AS origins"
_BITMAP = "bit_or(CAST(1 AS BIGINT) << (day(date) - 1))"
_AGREE = f""", per AS (SELECT i.date, i.source, i.net, i.len, max(CASE WHEN i.origin = v.origin THEN 1 ELSE 0 END) AS same
  FROM irrs i JOIN vrps v ON v.date = i.date AND {inside("i", "v")} GROUP BY 1, 2, 3, 4)"""
_LIVE = ", live AS (SELECT DISTINCT date, net, len, origins[1] AS origin FROM bgps WHERE len(origins) = 1)"
_WND = ", ".join(f"({w})" for w in WINDOWS)
# every day of every row and window one by one; runs by changes of state
_RUNS = f""", grid AS (SELECT f.feat_id, i.i, o.d IS NOT NULL AS up FROM (SELECT DISTINCT feat_id FROM bgp_feature) f CROSS JOIN range(0, 365) i(i)
  LEFT JOIN offs o ON o.feat_id = f.feat_id AND o.d = i.i),
steps AS (SELECT *, lag(up) OVER (PARTITION BY feat_id ORDER BY i) AS was FROM grid),
marked AS (SELECT *, sum(CASE WHEN was <> up THEN 1 ELSE 0 END) OVER (PARTITION BY feat_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM steps),
seen AS (SELECT m.*, w.w FROM marked m JOIN (VALUES {_WND}) w(w) ON m.i < w.w),
parts AS (SELECT feat_id, w, run, bool_or(up) AS up, count(*) AS n, max(i) AS hi FROM seen GROUP BY 1, 2, 3),
runstat AS (SELECT feat_id, w, min(n) FILTER (up) AS a0, max(n) FILTER (up) AS a1, avg(n) FILTER (up) AS a2, stddev_pop(n) FILTER (up) AS a3,
    min(n) FILTER (NOT up) AS b0, max(n) FILTER (NOT up) AS b1, avg(n) FILTER (NOT up) AS b2, stddev_pop(n) FILTER (NOT up) AS b3
  FROM parts WHERE NOT (w > 365 AND hi = 364) GROUP BY 1, 2),
daystat AS (SELECT feat_id, w, count(*) FILTER (up) AS n, coalesce(max(i) FILTER (up) - min(i) FILTER (up) + 1, 0) AS life,
    count(*) FILTER (was AND NOT up) AS ups, count(*) FILTER (NOT was AND up) AS downs FROM seen GROUP BY 1, 2),
metrics AS (SELECT d.feat_id, d.w AS wnd, round(n / d.w, 6) AS uptime, round(life / d.w, 6) AS lifespan, round(CASE WHEN life = 0 THEN 0.0 ELSE n / life END, 6) AS "relUptime",
    CAST(ups AS DOUBLE) AS ups, CAST(downs AS DOUBLE) AS downs, CAST(coalesce(a0, 0) AS DOUBLE) AS "minActiveDays", CAST(coalesce(a1, 0) AS DOUBLE) AS "maxActiveDays",
    round(coalesce(a2, 0), 6) AS "meanActiveDays", round(coalesce(a3, 0), 6) AS "stdActiveDays", CAST(coalesce(b0, 0) AS DOUBLE) AS "minInactiveDays",
    CAST(coalesce(b1, 0) AS DOUBLE) AS "maxInactiveDays", round(coalesce(b2, 0), 6) AS "meanInactiveDays", round(coalesce(b3, 0), 6) AS "stdInactiveDays"
  FROM daystat d LEFT JOIN runstat r USING (feat_id, w))"""
_STATS = ", ".join(
    f'round({f}("{m}"), 8) AS "{m}_{n}"' for m in ("uptime", "ups", "meanActiveDays", "maxInactiveDays") for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop"))
)
_BLOCK_CIDR = """RECURSIVE blocks(date, rir, start_ip, pos, left_n) AS (SELECT date, rir, start_ip, start_ip, num_ip FROM nro_block
  UNION ALL SELECT date, rir, start_ip, pos + step, left_n - step FROM (SELECT *, least(CAST(pow(2, floor(log2(left_n))) AS BIGINT), pos & (-pos)) AS step FROM blocks WHERE left_n > 0)),
cidr AS (SELECT date, rir, start_ip, pos AS net, CAST(32 - log2(least(CAST(pow(2, floor(log2(left_n))) AS BIGINT), pos & (-pos))) AS INT) AS len FROM blocks WHERE left_n > 0)"""


def _recursive(body: str) -> str:
    """The block table, its greedy decomposition, then ``body``."""
    head = with_inputs("nro_block", body=", " + _BLOCK_CIDR.removeprefix("RECURSIVE "))
    return "WITH RECURSIVE " + head.removeprefix("WITH ") + body


_SNAP = f"strptime('{SNAPSHOT}', '%Y%m%d')"

ORACLE = {
    "p_filter_ipv4_24": with_inputs("bgps", body=f"SELECT date, net, len, {_O}, total_cnt FROM bgps WHERE family = 4 AND len <= 24"),
    "p_filter_too_specific": with_inputs("bgps", body=f"SELECT date, net, len, {_O}, total_cnt FROM bgps WHERE len <= CASE family WHEN 4 THEN 24 ELSE 48 END"),
    "p_irr_trycast": with_inputs("irrs", body="SELECT date, net, len, origin, source, changed FROM irrs WHERE changed IS NOT NULL"),
    "p_moas_split": with_inputs("bgps", body="SELECT date, net, len, unnest(origins) AS origin, total_cnt FROM bgps"),
    "p_single_origin": with_inputs("bgps", body=_LIVE + " SELECT * FROM live"),
    "p_record_type": with_inputs("scoreds", body="""SELECT idx, CASE validation WHEN 'valid' THEN 1 WHEN 'invalid' THEN 0 ELSE -1 END AS label,
  CASE WHEN record_type = 'inactive' THEN 'inactive' WHEN validation = 'invalid' AND sum_rel <> 'none' THEN 'excluded' WHEN validation IN ('valid', 'invalid') THEN 'covered' ELSE 'not-covered' END AS kind FROM scoreds"""),
    "p_reject_filter": with_inputs("scoreds", body="SELECT idx FROM scoreds WHERE score0 * score1 <= 0 AND greatest(score0, score1) > 0"),
    "p_prediction_filter": with_inputs("scoreds", body="SELECT idx, net, len, origin FROM scoreds WHERE record_type <> 'inactive' AND validation = 'unknown'"),
    "p_active_origins": with_inputs("offs", body="SELECT feat_id, round(count(*) / 14, 6) AS uptime_2weeks FROM offs WHERE d < 14 GROUP BY 1 HAVING count(*) / 14 > 0.8"),
    "p_replicate_totals": with_inputs("vrps", body=f"SELECT date, total, source FROM (SELECT date, count(*) AS total FROM vrps GROUP BY 1) CROSS JOIN (VALUES {', '.join(f'({x!r})' for x in (*SOURCES, ALL))}) n(source)"),
    "f_prefix_text": f"SELECT DISTINCT ON ({_DAY}, rir, prefix, origin, isp, country, upper(source), changed) {_DAY} AS date, upper(source) AS source, origin, prefix FROM irr",
    "f_num_ip": with_inputs("vrps", body="SELECT date, uri, CAST(pow(2, 32 - len) AS BIGINT) AS num_ip FROM vrps"),
    "f_binary_prefix": with_inputs("irrs", body="SELECT DISTINCT net, len, substr(bits, 1, len) AS bits FROM irrs"),
    "f_common_prefix": with_inputs("nro_block", body=""", l AS (SELECT *, (SELECT max(k) FROM range(0, 33) r(k) WHERE start_ip // CAST(pow(2, 32 - k) AS BIGINT) = (start_ip + num_ip - 1) // CAST(pow(2, 32 - k) AS BIGINT)) AS len FROM nro_block)
SELECT date, rir, start_ip, num_ip, (start_ip // CAST(pow(2, 32 - len) AS BIGINT)) * CAST(pow(2, 32 - len) AS BIGINT) AS net, CAST(len AS INT) AS len FROM l"""),
    "f_cidr_expand": _recursive("\nSELECT date, rir, start_ip, net, len FROM cidr"),
    "f_asn_expand": with_inputs("nro_asn", body="SELECT date, rir, unnest(range(asn_start, asn_start + num_asn)) AS asn FROM nro_asn"),
    "f_date_diff": with_inputs("irrs", body=f"SELECT date, source, net, len, origin, CASE WHEN changed IS NULL THEN -1 ELSE coalesce(date_diff('day', TRY_STRPTIME(CAST(changed AS VARCHAR), '%Y%m%d'), {_SNAP}), -2) END AS age FROM irrs"),
    "f_softmax": with_inputs("scoreds", body=METHODS + " SELECT idx, round(yp, 6) AS y_pred FROM judged"),
    "f_softplus": with_inputs("scoreds", body="SELECT idx, round(ln(1 + exp(score0)), 6) AS softplus0 FROM scoreds WHERE score0 IS NOT NULL"),
    "f_asdot": with_inputs("irrs", body="SELECT DISTINCT origin, 'AS' || CAST(origin // 65536 AS VARCHAR) || '.' || CAST(origin % 65536 AS VARCHAR) AS asdot, origin AS parsed FROM irrs"),
    "f_bit_ops": f""", b AS (SELECT nlri, CAST(strftime(date, '%Y%m') AS INT) AS month, {_BITMAP} AS bits FROM bgp_update WHERE nlri IS NOT NULL GROUP BY 1, 2)
SELECT nlri, month, CAST((bits >> 2) & 1 AS INT) AS tested, bits | 4 AS set_bit, CASE WHEN bits & 4 = 4 THEN bits - 4 ELSE bits END AS cleared, xor(bits, 4) AS toggled, CAST(bit_count(bits) AS INT) AS n_days FROM b""".replace(", b AS", "WITH b AS", 1),
    "f_month_days": """WITH m AS (SELECT DISTINCT month, strptime(CAST(month AS VARCHAR) || '01', '%Y%m%d') AS f FROM bgp_feature)
SELECT month, CAST(day(last_day(f)) AS INT) AS n_days, CAST(strftime(f + INTERVAL 1 MONTH, '%Y%m') AS INT) AS next_month, CAST(strftime(f - INTERVAL 1 MONTH, '%Y%m') AS INT) AS last_month FROM m""",
    "f_rir_names": """SELECT from_rir, CASE WHEN lower(from_rir) IN ('ripe', 'ripe ncc', 'ripencc') THEN 'ripencc' WHEN lower(from_rir) = 'jpnic' THEN 'apnic'
  WHEN lower(from_rir) IN ('apnic', 'arin', 'afrinic', 'lacnic') THEN lower(from_rir) END AS rir, count(*) AS n FROM transfer GROUP BY from_rir""",
    "f_date_list": """SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS day, CASE WHEN d IN (SELECT date FROM irr) THEN 1 ELSE 0 END AS has_snapshot
FROM (SELECT CAST(unnest(generate_series(min(CAST(date AS TIMESTAMP)), max(CAST(date AS TIMESTAMP)), INTERVAL 1 DAY)) AS DATE) AS d FROM irr)""",
    "j_cover": with_inputs("vrps", "bgps", body=f"""SELECT b.date, b.net, b.len, v.net AS c_net, v.len AS c_len, v.max_len AS c_max_len, v.origin AS c_origin
FROM (SELECT DISTINCT date, family, net, bits, len FROM bgps) b JOIN (SELECT DISTINCT date, family, net, bits, len, max_len, origin FROM vrps) v ON v.date = b.date AND {inside("b", "v")}"""),
    "j_validate": with_inputs("irrs", "vrps", body=VALIDATED + " SELECT date, source, net, len, origin, validation FROM validated"),
    "j_rir_attribution": "WITH RECURSIVE " + with_inputs("nro_block", "nro_block6", "bgps", body=", " + _BLOCK_CIDR.removeprefix("RECURSIVE ")).removeprefix("WITH ")
    + f""", every AS (SELECT date, rir, len, 4 AS family, lpad(bin(net), 32, '0') AS bits FROM cidr UNION ALL SELECT date, rir, 32, 6, {bits_of_hex(hex_text("split_part(prefix, '/', 1)"))} FROM nro_block6)
SELECT b.date, b.net, b.len, arg_min(c.rir, struct_pack(a := c.len, b := c.rir)) AS nro_rir FROM (SELECT DISTINCT date, family, net, bits, len FROM bgps) b JOIN every c ON c.date = b.date AND {inside('b', 'c')} GROUP BY 1, 2, 3""",
    "j_as_org": with_inputs("irrs", "as_org", body=""", near AS (SELECT d.date, arg_min(s.snapshot, struct_pack(a := abs(date_diff('day', strptime(CAST(d.date AS VARCHAR), '%Y%m%d'), strptime(CAST(s.snapshot AS VARCHAR), '%Y%m%d'))), b := s.snapshot)) AS snapshot
FROM (SELECT DISTINCT date FROM irrs) d CROSS JOIN (SELECT DISTINCT snapshot FROM as_org) s GROUP BY 1)
SELECT o.date, o.origin, coalesce(a.org, '') AS org, coalesce(a.country, '') AS country FROM (SELECT DISTINCT date, origin FROM irrs) o JOIN near n USING (date) LEFT JOIN as_org a ON a.snapshot = n.snapshot AND a.asn = o.origin"""),
    "j_nearest_snapshot": with_inputs("irrs", "as_org", body="""SELECT d.date, arg_min(s.snapshot, struct_pack(a := abs(date_diff('day', strptime(CAST(d.date AS VARCHAR), '%Y%m%d'), strptime(CAST(s.snapshot AS VARCHAR), '%Y%m%d'))), b := s.snapshot)) AS snapshot
FROM (SELECT DISTINCT date FROM irrs) d CROSS JOIN (SELECT DISTINCT snapshot FROM as_org) s GROUP BY 1"""),
    "j_relationship": COMPOSITE["q10_irr_validation"].replace("CASE WHEN NOT covered THEN 'unknown' WHEN hit THEN 'valid' ELSE 'invalid' END AS validation,", ""),
    "j_active_inner": with_inputs("irrs", "bgps", body=f"""{_LIVE}, a AS (SELECT DISTINCT i.date, i.source, i.net, i.len, i.origin FROM irrs i JOIN live l ON l.date = i.date AND l.net = i.net AND l.len = i.len AND l.origin = i.origin)
SELECT * FROM a UNION SELECT date, '{ALL}', net, len, origin FROM a"""),
    "j_feature_join": f"""SELECT DISTINCT {_DAY} AS date, i.source, i.prefix, i.origin, f.feat_id, f.uptime_30 FROM irr i JOIN bgp_feature f ON f.origin = i.origin
  AND i.prefix = f.prefix_addr || '/' || CAST(f.prefix_len AS VARCHAR) AND strftime(i.date, '%Y%m') = strftime(strptime(CAST(f.month AS VARCHAR) || '01', '%Y%m%d') + INTERVAL 1 MONTH, '%Y%m')""",
    "j_full_outer_max": with_inputs("irrs", "vrps", "bgps", body=ACTIVE + " SELECT source, net, len, origin, validation, max(date) AS latest_date FROM active GROUP BY 1, 2, 3, 4, 5"),
    "j_transfer_label": COMPOSITE["q17_transfer_label"].replace("SELECT idx, date AS transferred_date, from_isp, to_isp, CASE", "SELECT idx, CASE"),
    "j_other_active_origin": COMPOSITE["q17_transfer_label"].split(",\nhits AS")[0] + " SELECT idx FROM rival",
    "j_origin_sets_meet": with_inputs("irrs", "vrps", body=_AGREE + " SELECT date, source, net, len, CAST(same AS BIGINT) AS same FROM per"),
    "j_totals_left": with_inputs("irrs", "nro_asn", body=""", t AS (SELECT date, rir, count(DISTINCT asn) AS whole FROM (SELECT date, rir, unnest(range(asn_start, asn_start + num_asn)) AS asn FROM nro_asn) GROUP BY 1, 2)
SELECT r.date, r.rir, r.n_asn, coalesce(t.whole, 0) AS whole FROM (SELECT date, rir, count(DISTINCT origin) AS n_asn FROM irrs GROUP BY 1, 2) r LEFT JOIN t ON t.date = r.date AND t.rir = r.rir"""),
    "a_count": with_inputs("irrs", body="SELECT date, source, count(*) AS n FROM irrs GROUP BY 1, 2"),
    "a_count_distinct": with_inputs("irrs", body="SELECT date, source, count(DISTINCT origin) AS n_origins, count(DISTINCT (net, len)) AS n_prefixes FROM irrs GROUP BY 1, 2"),
    "a_vector_sum": with_inputs("irrs", "vrps", body=VALIDATED + " SELECT date, source, count(*) FILTER (validation = 'valid') AS valid, count(*) FILTER (validation = 'invalid') AS invalid, count(*) FILTER (validation = 'unknown') AS unknown FROM validated GROUP BY 1, 2"),
    "a_vantage_points": with_inputs("bgps", body=f"SELECT date, net, len, {_O}, total_cnt FROM bgps"),
    "a_grouping_sets": with_inputs("irrs", body=f""", r AS (SELECT date, unnest([coalesce(rir, 'None'), 'total']) AS rir, source, origin FROM irrs), r2 AS (SELECT * FROM r UNION ALL SELECT date, rir, '{ALL}', origin FROM r)
SELECT date, rir, source, count(DISTINCT origin) AS n_asn FROM r2 GROUP BY 1, 2, 3"""),
    "a_pivot_rir": with_inputs("irrs", body="SELECT date, source, " + ", ".join(f"count(DISTINCT CASE WHEN rir = '{r}' THEN origin END) AS {r}" for r in RIRS) + " FROM irrs GROUP BY 1, 2"),
    "a_pivot_relation": with_inputs("irrs", "vrps", body=_AGREE + " SELECT date, count(*) AS overlap, CAST(sum(same) AS BIGINT) AS same, CAST(sum(1 - same) AS BIGINT) AS discrepant FROM per GROUP BY 1"),
    "a_ip_union": with_inputs("irrs", body=f""", sp AS (SELECT DISTINCT date, source, family, {first_unit("bits")} AS s, {first_unit("bits")} + {units("len", "family")} AS e FROM irrs),
isl AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY date, source, family ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM sp),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY date, source, family ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM isl)
SELECT date, source, family, CAST(sum(n) AS BIGINT) AS num_ip FROM (SELECT date, source, family, k, max(e) - min(s) AS n FROM g GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""),
    "a_bitvector": f"""SELECT nlri, origin, CAST(strftime(date, '%Y%m') AS INT) AS month, {_BITMAP} AS bits, lpad(bin({_BITMAP}), CAST(day(last_day(min(date))) AS INT), '0') AS bit_text
FROM bgp_update WHERE nlri IS NOT NULL AND origin IS NOT NULL GROUP BY 1, 2, 3""",
    "a_run_metrics": with_inputs("offs", body=_RUNS + " SELECT * FROM metrics"),
    "q15_feature_stats": with_inputs("offs", body=_RUNS + f" SELECT feat_id, {_STATS} FROM metrics GROUP BY 1"),
    "q14_bitvector": f"""SELECT CAST(strftime(date, '%Y%m') AS INT) AS month, nlri, CAST(origin AS BIGINT) AS origin, lpad(bin({_BITMAP}), CAST(day(last_day(min(date))) AS INT), '0') AS bit_text
FROM bgp_update WHERE nlri IS NOT NULL AND TRY_CAST(origin AS BIGINT) IS NOT NULL GROUP BY nlri, origin, CAST(strftime(date, '%Y%m') AS INT)""",
    "q20_nro_expand": "WITH RECURSIVE " + with_inputs("nro_block", "nro_asn", body=", " + _BLOCK_CIDR.removeprefix("RECURSIVE ")).removeprefix("WITH ") + """
SELECT date, rir, 'ipv4' AS kind, CAST(net // 16777216 AS VARCHAR) || '.' || CAST(net // 65536 % 256 AS VARCHAR) || '.' || CAST(net // 256 % 256 AS VARCHAR) || '.' || CAST(net % 256 AS VARCHAR) || '/' || CAST(len AS VARCHAR) AS resource FROM cidr
UNION ALL SELECT date, rir, 'asn', CAST(unnest(range(asn_start, asn_start + num_asn)) AS VARCHAR) FROM nro_asn""",
    "q21_transfers_flatten": f"""SELECT {_DAY} AS date, prefix_addr, prefix_len, CASE from_rir WHEN 'RIPE NCC' THEN 'RIPE' ELSE from_rir END AS from_rir, from_isp,
  CASE to_rir WHEN 'RIPE NCC' THEN 'RIPE' ELSE to_rir END AS to_rir, to_isp, transfer_type FROM transfer WHERE NOT contains(prefix_addr, ':')""",
    "s_rpsl_routes": f"SELECT DISTINCT {_DAY} AS date, source, prefix, origin, changed FROM irr",
    "f_rejection_loss": with_inputs("scoreds", body="""SELECT idx, round((0.6 * ((1 - t) * ln(1 + exp(-score0)) + t * ln(1 + exp(score0))) + 0.4 * ((1 - t) * ln(1 + exp(score1)) + t * ln(1 + exp(-score1)))
  + 0.6 * (t * ln(1 + exp(-score1)) + (1 - t) * ln(1 + exp(score1))) + 0.4 * (t * ln(1 + exp(score0)) + (1 - t) * ln(1 + exp(-score0)))) / 2, 6) AS loss
FROM (SELECT *, CASE validation WHEN 'valid' THEN 1 ELSE 0 END AS t FROM scoreds WHERE validation IN ('valid', 'invalid') AND score0 IS NOT NULL AND score1 IS NOT NULL)"""),
    "j_substitute_days": f"""SELECT r.source, {_DAY.replace("date", "d.date")} AS date, CAST(strftime((SELECT min(s.date) FROM irr s WHERE s.source = r.source AND s.date >= d.date), '%Y%m%d') AS INT) AS use_date
FROM (SELECT source, min(date) AS a, max(date) AS b FROM irr GROUP BY 1) r JOIN (SELECT DISTINCT date FROM bgp_update WHERE date IS NOT NULL) d ON d.date BETWEEN r.a AND r.b""",
    "a_percent": with_inputs("irrs", "vrps", "bgps", body=Q1 + " SELECT date, family, source, round(CASE WHEN covered = 0 THEN 0.0 ELSE 100.0 * valid / covered END, 6) AS valid_pct FROM q1"),
    "w_active_cdf": "SELECT family, source, latest_date, irr, irr_total FROM (" + COMPOSITE["q12_active_cdf"] + ")",
    "w_age_cdf": "SELECT date, source, age, cdf FROM (" + COMPOSITE["q13_irr_age_cdf"] + ") WHERE validation = 'all'",
    "w_pr_curve": COMPOSITE["q16_pr_curve"],
    "w_auc_pr": COMPOSITE["q16_auc_pr"],
    "w_rolling_14d": f"""WITH t AS (SELECT DISTINCT nlri, date FROM bgp_update WHERE nlri IS NOT NULL)
SELECT a.nlri, CAST(strftime(a.date, '%Y%m%d') AS INT) AS date, count(*) AS n_days FROM t a JOIN t b ON a.nlri = b.nlri AND date_diff('day', b.date, a.date) BETWEEN 0 AND 13 GROUP BY 1, 2""",
    "w_month_contiguity": """WITH m AS (SELECT DISTINCT month FROM bgp_feature) SELECT a.month, CASE WHEN a.month = (SELECT min(month) FROM m)
  OR EXISTS (SELECT 1 FROM m b WHERE b.month // 100 * 12 + b.month % 100 + 1 = a.month // 100 * 12 + a.month % 100) THEN 1 ELSE 0 END AS follows FROM m a""",
    "w_run_islands": f"""WITH t AS (SELECT DISTINCT nlri, date FROM bgp_update WHERE nlri IS NOT NULL),
s AS (SELECT *, CASE WHEN date_diff('day', lag(date) OVER (PARTITION BY nlri ORDER BY date), date) = 1 THEN 0 ELSE 1 END AS fresh FROM t),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY nlri ORDER BY date ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT nlri, CAST(strftime(min(date), '%Y%m%d') AS INT) AS first_day, CAST(strftime(max(date), '%Y%m%d') AS INT) AS last_day, count(*) AS n_days FROM g GROUP BY nlri, k""",
    "u_union": with_inputs("irrs", "vrps", body="SELECT date, net, len, origin FROM irrs UNION ALL SELECT date, net, len, origin FROM vrps"),
    "u_distinct": with_inputs("irrs", "vrps", body="SELECT date, net, len, origin FROM irrs UNION SELECT date, net, len, origin FROM vrps"),
    "u_except": with_inputs("irrs", "vrps", body="SELECT date, net, len, origin FROM irrs EXCEPT SELECT date, net, len, origin FROM vrps"),
    "u_intersect": with_inputs("irrs", "vrps", body="SELECT date, net, len, origin FROM irrs INTERSECT SELECT date, net, len, origin FROM vrps"),
    "u_dates_missing": f"SELECT DISTINCT {_DAY} AS date FROM bgp_update WHERE date IS NOT NULL AND date NOT IN (SELECT date FROM irr WHERE date IS NOT NULL)",
    "l_topk": with_inputs("bgps", body=f"SELECT * FROM (SELECT date, net, len, {_O}, total_cnt FROM bgps WHERE len <= CASE family WHEN 4 THEN 24 ELSE 48 END) ORDER BY total_cnt DESC, date, net, len, origins LIMIT 20"),
    "l_cover_shortest": with_inputs("irrs", "vrps", body=f"SELECT i.date, i.net, i.len, min(v.len) AS c_len, arg_min(v.net, v.len) AS c_net FROM irrs i JOIN vrps v ON v.date = i.date AND {inside('i', 'v')} GROUP BY 1, 2, 3"),
    "l_low_watermark": f"SELECT CAST(strftime(max(lo), '%Y%m%d') AS INT) AS first_day, CAST(strftime(min(hi), '%Y%m%d') AS INT) AS last_day FROM (SELECT min(date) AS lo, max(date) AS hi FROM irr UNION ALL SELECT min(date), max(date) FROM bgp_update UNION ALL SELECT min(date), max(date) FROM vrp)",
    "l_argmax": with_inputs("irrs", "vrps", body=VALIDATED + """, n AS (SELECT date, source, count(*) FILTER (validation = 'valid') AS valid FROM validated GROUP BY 1, 2)
SELECT date, source, valid FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY valid DESC, source) AS rn FROM n) WHERE rn = 1"""),
    "s_events_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}

_YEAR = f"""days AS (SELECT DISTINCT nlri, origin, date FROM bgp_update WHERE nlri IS NOT NULL AND TRY_CAST(origin AS BIGINT) IS NOT NULL AND date IS NOT NULL),
ends AS (SELECT last_day(m) AS e, CAST(strftime(m, '%Y%m') AS INT) AS month FROM (SELECT unnest(generate_series(date_trunc('month', CAST((SELECT min(date) FROM days) AS TIMESTAMP)), CAST((SELECT max(date) FROM days) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m)),
back AS (SELECT nlri, origin, month, date_diff('day', date, CAST(e AS DATE)) AS d FROM days JOIN ends ON date_diff('day', date, CAST(e AS DATE)) BETWEEN 0 AND 364)"""
_WIDE = ", ".join(f'max(CASE WHEN wnd = {w} THEN "{m}" END) AS "{m}_{w}"' for m in METRICS for w in WINDOWS)
_ALL_STATS = ", ".join(f'round({f}("{m}"), 8) AS "{m}_{n}"' for m in METRICS for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop")))
_LABELS = "labels AS (SELECT DISTINCT idx, CASE validation WHEN 'valid' THEN 1 ELSE 0 END AS label FROM scoreds WHERE validation IN ('valid', 'invalid') AND score0 IS NOT NULL AND score1 IS NOT NULL), sizes AS (SELECT label, count(*) AS n FROM labels GROUP BY 1)"

ORACLE |= {
    "q15_bgp_feature": with_inputs("offs", body=_RUNS + f" SELECT feat_id, {_WIDE}, {_ALL_STATS} FROM metrics GROUP BY 1"),
    "w_year_presence": f"WITH {_YEAR} SELECT nlri, origin, month, CAST(count(*) AS INT) AS n_days, CAST(min(d) AS INT) AS newest, CAST(max(d) AS INT) AS oldest FROM back GROUP BY 1, 2, 3",
    "w_year_metrics": f"WITH {_YEAR}, offs AS (SELECT nlri || ' ' || origin || ' ' || month AS feat_id, d FROM back)" + _RUNS.replace("FROM bgp_feature", "FROM offs") + " SELECT * FROM metrics",
    "p_bitvector_rows": f"""SELECT CAST(strftime(date, '%Y%m') AS INT) AS month, split_part(nlri, '/', 1) AS prefix_addr, CAST(split_part(nlri, '/', 2) AS INT) AS prefix_len, CAST(origin AS BIGINT) AS origin, {_BITMAP} AS bits
FROM bgp_update WHERE nlri IS NOT NULL AND TRY_CAST(origin AS BIGINT) IS NOT NULL GROUP BY nlri, origin, CAST(strftime(date, '%Y%m') AS INT)""",
    "p_ancestors": with_inputs("vrps", body="SELECT DISTINCT uri, len, CAST(k AS INT) AS alen, substr(bits, 1, k) AS bits FROM vrps, range(8, 129) r(k) WHERE k <= len"),
    "p_irr_keyed": with_inputs("irrs", body=f"SELECT DISTINCT date, unnest([source, '{ALL}']) AS source, net, len, origin FROM irrs"),
    "f_within_limit": with_inputs("irrs", body="""SELECT date, source, net, len, origin, changed,
  CASE WHEN date_diff('day', TRY_STRPTIME(CAST(changed AS VARCHAR), '%Y%m%d'), strptime(CAST(date AS VARCHAR), '%Y%m%d')) > 365 THEN 0 ELSE 1 END AS within FROM irrs"""),
    "f_bit_words": f"""WITH b AS (SELECT nlri, CAST(origin AS BIGINT) AS origin, CAST(strftime(date, '%Y%m') AS INT) AS month, {_BITMAP} AS bits, CAST(day(last_day(min(date))) AS INT) AS n
  FROM bgp_update WHERE nlri IS NOT NULL AND TRY_CAST(origin AS BIGINT) IS NOT NULL GROUP BY nlri, bgp_update.origin, CAST(strftime(date, '%Y%m') AS INT))
SELECT nlri, origin, month, concat_ws('|', bits % 256, bits // 256 % 256, bits // 65536 % 256, bits // 16777216) AS words8, CAST(bits AS VARCHAR) AS words32, bits AS again,
  bits * 8 % CAST(pow(2, n) AS BIGINT) AS later, bits * 8 % CAST(pow(2, n) AS BIGINT) + 7 AS later_filled FROM b""",
    "j_predictions": with_inputs("scoreds", body=""", p AS (SELECT DISTINCT idx, score0, score1 FROM scoreds WHERE score0 IS NOT NULL AND score1 IS NOT NULL)
SELECT s.idx, s.date, s.net, s.len, s.origin, round(p.score0, 6) AS score0, round(p.score1, 6) AS score1 FROM scoreds s JOIN p USING (idx)"""),
    "u_target_dates": f"SELECT {_DAY} AS date FROM irr WHERE date IS NOT NULL UNION SELECT {_DAY} FROM bgp_update WHERE date IS NOT NULL UNION SELECT {_DAY} FROM vrp WHERE date IS NOT NULL",
    "l_date_batches": f"SELECT a.date, CAST(count(b.date) // 3 AS INT) AS batch FROM (SELECT DISTINCT {_DAY} AS date FROM irr) a LEFT JOIN (SELECT DISTINCT {_DAY} AS date FROM irr) b ON b.date < a.date GROUP BY 1",
    "i_due_days": f"""SELECT DISTINCT {_DAY} AS date FROM irr WHERE date IN (SELECT date FROM bgp_update) AND date > (SELECT max(date) FROM irr WHERE {_DAY} <= 20230215)
  AND date <= least((SELECT max(date) FROM irr), (SELECT max(date) FROM bgp_update))""",
    "i_single_input": f"SELECT DISTINCT {_DAY} AS date FROM irr WHERE date > (SELECT max(date) FROM irr WHERE {_DAY} <= 20230215)",
    "i_due_months": "SELECT DISTINCT CAST(strftime(date, '%Y%m') AS INT) AS month FROM bgp_update WHERE strftime(date, '%Y%m') < (SELECT strftime(max(date), '%Y%m') FROM bgp_update) AND strftime(date, '%Y%m') <> '202301'",
    "i_complete_days": "SELECT CAST(strftime(CAST(ts AS DATE), '%Y%m%d') AS INT) AS date FROM bgp_update WHERE ts IS NOT NULL GROUP BY 1 HAVING max(hour(ts)) = 23",
    "m_split": with_inputs("scoreds", body=", " + _LABELS + " SELECT label, 'train' AS part, CAST(floor(0.8 * n) AS BIGINT) AS n FROM sizes UNION ALL SELECT label, 'test', n - CAST(floor(0.8 * n) AS BIGINT) FROM sizes"),
    "m_folds": with_inputs("scoreds", body=", " + _LABELS + " SELECT label, CAST(f AS INT) AS fold, n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS n FROM sizes, range(0, 5) r(f)"),
}
