"""DuckDB text of the composite queries, with containment as a range comparison."""

from __future__ import annotations

from netledger.operators.registry import SCRUBBERS
from netledger.plans.composites import ALL, LOOK_BACK, RIRS, SOURCES, THRESHOLD
from netledger.plans.inputs import bits_of_hex, hex_text, with_inputs


def inside(p: str, c: str) -> str:
    """Prefix ``p`` lies in prefix ``c``."""
    return f"{c}.family = {p}.family AND {c}.len > 0 AND {c}.len <= {p}.len AND substr({p}.bits, 1, {c}.len) = substr({c}.bits, 1, {c}.len)"


ROUTED = """routed AS (SELECT *, CASE WHEN len(origins) = 1 THEN origins[1] END AS origin FROM bgps
  WHERE len <= CASE family WHEN 4 THEN 24 ELSE 48 END AND date IN (SELECT DISTINCT CAST(strftime(date, '%Y%m%d') AS INT) FROM irr))"""
_V_HIT = "b.origin = v.origin AND b.len <= v.max_len"
_NAMES = ", ".join(f"('{s}')" for s in ("VRP", *SOURCES, ALL))

BY_SOURCE = f""", {ROUTED},
byv AS (SELECT b.date, b.family, b.net, b.len, b.origins, 'VRP' AS source, max(CASE WHEN {_V_HIT} THEN 1 ELSE 0 END) AS ok
  FROM routed b JOIN vrps v ON v.date = b.date AND {inside("b", "v")} GROUP BY ALL),
byi AS (SELECT b.date, b.family, b.net, b.len, b.origins, i.source, max(CASE WHEN b.origin = i.origin THEN 1 ELSE 0 END) AS ok
  FROM routed b JOIN irrs i ON i.date = b.date AND i.changed IS NOT NULL AND {inside("b", "i")} GROUP BY ALL),
alli AS (SELECT date, family, net, len, origins, '{ALL}' AS source, max(ok) AS ok FROM byi GROUP BY ALL),
flagged AS (SELECT * FROM byv UNION ALL SELECT * FROM byi WHERE source IN {SOURCES} UNION ALL SELECT * FROM alli)"""

Q1 = f"""{BY_SOURCE},
q1 AS (SELECT t.date, t.family, 'total' AS rir, n.source, t.total, coalesce(c.covered, 0) AS covered, coalesce(c.valid, 0) AS valid
  FROM (SELECT date, family, count(*) AS total FROM routed GROUP BY ALL) t CROSS JOIN (VALUES {_NAMES}) n(source)
  LEFT JOIN (SELECT date, family, source, count(*) AS covered, CAST(sum(ok) AS BIGINT) AS valid FROM flagged GROUP BY ALL) c ON c.date = t.date AND c.family = t.family AND c.source = n.source)"""

_COLS = "".join(
    f", coalesce(max(CASE WHEN rir = '{r}' THEN v END), 0) AS \"{r}_cnt\", coalesce(max(CASE WHEN rir = '{r}' THEN whole END), 0) AS \"{r}_total\"" for r in ("total", *RIRS, "None")
)


def first_unit(bits: str) -> str:
    """Number of the IPv4 address or of the IPv6 network of length 64 that the bits begin with."""
    return f"list_reduce(list_transform(string_split(substr({bits}, 1, 64), ''), lambda x: CAST(x AS HUGEINT)), lambda a, x: a * 2 + x)"


def units(length: str, family: str) -> str:
    return f"CAST(pow(2, greatest(0, CASE {family} WHEN 4 THEN 32 ELSE 64 END - {length})) AS HUGEINT)"


def _union_size(table: str, keys: str) -> str:
    """Distinct addresses of spans (s, e) per key by a running maximum."""
    return f"""(SELECT {keys}, CAST(sum(greatest(0, e - greatest(s, coalesce(reach, s)))) AS BIGINT) AS v FROM (
  SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {table}) GROUP BY {keys})"""


_YPRED = "CASE record_type WHEN 'inactive' THEN 0.0 WHEN 'excluded' THEN 1.0 ELSE 1 / (1 + exp(score0 - score1)) END"
METHODS = f""", judged AS (SELECT *, CASE validation WHEN 'valid' THEN 1 WHEN 'invalid' THEN 0 ELSE -1 END AS yt, {_YPRED} AS yp FROM scoreds),
methods AS (SELECT *, 'IRR' AS method FROM judged UNION ALL SELECT *, 'IRRd4' FROM judged WHERE yt <> 0
  UNION ALL SELECT *, 'IRR-ML' FROM judged WHERE (yt = 1 OR yp > 0) AND yp >= {THRESHOLD})"""
VALIDATED = f""", validated AS (SELECT i.date, i.family, i.source, i.net, i.len, i.origin, CASE WHEN max(v.date) IS NULL THEN 'unknown'
    WHEN bool_or(coalesce(v.origin = i.origin AND i.len <= v.max_len, false)) THEN 'valid' ELSE 'invalid' END AS validation
  FROM (SELECT DISTINCT date, family, source, net, bits, len, origin FROM irrs) i LEFT JOIN vrps v ON v.date = i.date AND {inside("i", "v")} GROUP BY ALL)"""
ACTIVE = f"""{VALIDATED}, act0 AS (SELECT v.* FROM validated v WHERE EXISTS (SELECT 1 FROM bgps b WHERE len(b.origins) = 1 AND b.date = v.date AND b.net = v.net AND b.len = v.len AND b.origins[1] = v.origin)),
active AS (SELECT * FROM act0 UNION SELECT date, family, '{ALL}', net, len, origin, validation FROM act0)"""
# a key with two validations counts under each, and twice in the total
MERGED = f"""{ACTIVE}, lastly AS (SELECT family, source, net, len, origin, validation, max(date) AS d FROM active GROUP BY ALL),
merged AS (SELECT family, source, validation, d AS latest_date, count(*) AS cnt FROM lastly WHERE validation IN ('valid', 'invalid') GROUP BY ALL
  UNION ALL SELECT family, source, 'total', d, count(*) FROM lastly GROUP BY ALL)"""
LABELLED = """, labelled AS (SELECT *, round(1 / (1 + exp(score0 - score1)), 6) AS p, CASE validation WHEN 'valid' THEN 1 ELSE 0 END AS label FROM scoreds
  WHERE validation IN ('valid', 'invalid') AND score0 IS NOT NULL AND score1 IS NOT NULL)"""


def _curve(rows: str) -> str:
    return f"""(SELECT t AS threshold, tp / k AS precision, tp / pos AS recall, 2 * tp / (k + pos) AS f1 FROM (
  SELECT t, (SELECT CAST(sum(label) AS DOUBLE) FROM {rows} r WHERE r.p >= t) AS tp, (SELECT count(*) FROM {rows} r WHERE r.p >= t) AS k,
    (SELECT sum(label) FROM {rows}) AS pos FROM (SELECT DISTINCT p AS t FROM {rows})))"""


def _auc(rows: str) -> str:
    return f"""(SELECT sum((recall - coalesce(lr, 0)) * (precision + coalesce(lp, 1)) / 2) FROM (
  SELECT *, lag(recall) OVER (ORDER BY threshold DESC) AS lr, lag(precision) OVER (ORDER BY threshold DESC) AS lp FROM {_curve(rows)}))"""


_KEPT = "keepers AS (SELECT * FROM labelled WHERE score0 * score1 <= 0 AND greatest(score0, score1) > 0)"
EDGES = """, edges AS (SELECT a1, a2, min(rel) AS rel FROM (SELECT as1 AS a1, as2 AS a2, CASE WHEN rel = -1 THEN 'provider' ELSE 'peer' END AS rel FROM as_rel
  UNION ALL SELECT as2, as1, CASE WHEN rel = -1 THEN 'customer' ELSE 'peer' END FROM as_rel) GROUP BY 1, 2)"""
_SCRUB = ", ".join(map(str, SCRUBBERS))
RELATED = f"""{EDGES}, objs AS (SELECT DISTINCT date, family, source, net, bits, len, origin, isp FROM irrs),
ranked AS (SELECT o.date, o.source, o.net, o.len, o.origin, o.isp, max(v.date) IS NOT NULL AS covered,
    bool_or(coalesce(v.origin = o.origin AND o.len <= v.max_len, false)) AS hit,
    min(CASE WHEN o.len <= v.max_len THEN CASE WHEN o.origin = v.origin THEN 0 WHEN o.isp = v.isp THEN 1 WHEN e.rel IN ('provider', 'customer') THEN 2
      WHEN e.rel = 'peer' THEN 3 WHEN o.origin IN ({_SCRUB}) OR v.origin IN ({_SCRUB}) THEN 4 ELSE 5 END END) AS r
  FROM objs o LEFT JOIN vrps v ON v.date = o.date AND {inside("o", "v")} LEFT JOIN edges e ON e.a1 = o.origin AND e.a2 = v.origin GROUP BY ALL)"""

ORACLE = {
    "q1_bgp_coverage": with_inputs("irrs", "vrps", "bgps", body=f"{Q1} SELECT * FROM q1"),
    "q2_inconsistent_bgp": with_inputs("irrs", "vrps", "bgps", body=f"""{BY_SOURCE}, pair AS (SELECT v.date, v.family, len(v.origins) AS n, v.ok AS a, i.ok AS b
  FROM byv v JOIN alli i ON i.date = v.date AND i.net = v.net AND i.len = v.len AND i.origins = v.origins)
SELECT t.date, t.family, t.total, count(p.date) AS both_covered, count(CASE WHEN p.n > 1 OR p.a = p.b THEN p.date END) AS consistent,
  count(CASE WHEN p.n = 1 AND p.a <> p.b THEN p.date END) AS discrepant
FROM (SELECT date, family, count(*) AS total FROM routed GROUP BY ALL) t LEFT JOIN pair p ON p.date = t.date AND p.family = t.family GROUP BY 1, 2, 3"""),
    "q3_inconsistent_prefix": with_inputs("irrs", "vrps", body=f""", per AS (SELECT i.date, i.family, i.source, i.net, i.len, max(CASE WHEN i.origin = v.origin THEN 1 ELSE 0 END) AS same
  FROM irrs i JOIN vrps v ON v.date = i.date AND {inside("i", "v")} GROUP BY 1, 2, 3, 4, 5)
SELECT date, family, source, count(*) AS overlap, CAST(sum(same) AS BIGINT) AS same, CAST(sum(1 - same) AS BIGINT) AS discrepant
FROM (SELECT * FROM per UNION ALL SELECT date, family, '{ALL}', net, len, same FROM per) GROUP BY 1, 2, 3"""),
    "q4_ip_coverage": with_inputs("irrs", "vrps", "nro_block", "nro_block6", body=f""", rows0 AS (SELECT date, family, rir, source, bits, len FROM irrs UNION ALL SELECT date, family, rir, '{ALL}', bits, len FROM irrs UNION ALL SELECT date, family, rir, 'VRP', bits, len FROM vrps),
spans AS (SELECT date, family, source, unnest([coalesce(rir, 'None'), 'total']) AS rir, {first_unit("bits")} AS s, {first_unit("bits")} + {units("len", "family")} AS e FROM rows0),
blocks0 AS (SELECT date, 4 AS family, rir, CAST(start_ip AS HUGEINT) AS s, CAST(start_ip + num_ip AS HUGEINT) AS e FROM nro_block
  UNION ALL SELECT date, 6, rir, {first_unit("bits")}, {first_unit("bits")} + {units("32", "6")} FROM (SELECT *, {bits_of_hex(hex_text("split_part(prefix, '/', 1)"))} AS bits FROM nro_block6)),
blocks AS (SELECT date, family, unnest([rir, 'total']) AS rir, s, e FROM blocks0),
found AS {_union_size("spans", "date, family, source, rir")}, totals AS (SELECT date, family, rir, v AS whole FROM {_union_size("blocks", "date, family, rir")})
SELECT date, family, source{_COLS} FROM found LEFT JOIN totals USING (date, family, rir) GROUP BY 1, 2, 3"""),
    "q5_as_coverage": with_inputs("irrs", "vrps", "nro_asn", body=f""", rows0 AS (SELECT date, family, rir, source, origin FROM irrs UNION ALL SELECT date, family, rir, '{ALL}', origin FROM irrs UNION ALL SELECT date, family, rir, 'VRP', origin FROM vrps),
found AS (SELECT date, family, source, r AS rir, count(DISTINCT origin) AS v FROM (SELECT *, unnest([coalesce(rir, 'None'), 'total']) AS r FROM rows0) GROUP BY 1, 2, 3, 4),
totals AS (SELECT date, r AS rir, count(DISTINCT asn) AS whole FROM (SELECT date, unnest([CASE rir WHEN 'jpnic' THEN 'apnic' ELSE rir END, 'total']) AS r, asn
  FROM (SELECT *, unnest(range(asn_start, asn_start + num_asn)) AS asn FROM nro_asn)) GROUP BY 1, 2)
SELECT date, family, source{_COLS} FROM found LEFT JOIN totals USING (date, rir) GROUP BY 1, 2, 3"""),
    "q6_overlap": with_inputs("irrs", "vrps", body=f""", i2 AS (SELECT date, family, source, net, bits, len, origin FROM irrs UNION SELECT date, family, '{ALL}', net, bits, len, origin FROM irrs),
hits AS (SELECT i.date, i.family, i.source, i.net, i.len, i.origin, v.uri FROM i2 i JOIN vrps v ON v.date = i.date AND {inside("i", "v")}),
b AS (SELECT date, family, source, count(DISTINCT (net, len)) AS both_covered, count(DISTINCT uri) AS roa_both, count(DISTINCT (net, len, origin)) AS irr_both FROM hits GROUP BY 1, 2, 3),
it AS (SELECT date, family, source, count(DISTINCT (net, len, origin)) AS irr_total FROM i2 GROUP BY 1, 2, 3), rt AS (SELECT date, family, count(DISTINCT uri) AS roa_total FROM vrps GROUP BY 1, 2)
SELECT it.date, it.family, it.source, coalesce(both_covered, 0) AS both_covered, coalesce(roa_both, 0) AS roa_both, coalesce(roa_total, 0) AS roa_total, coalesce(irr_both, 0) AS irr_both, irr_total
FROM it LEFT JOIN rt USING (date, family) LEFT JOIN b USING (date, family, source)"""),
    "q7_eval_bgp_coverage": with_inputs("scoreds", "bgps", body=f"""{METHODS}, bb AS (SELECT *, CASE WHEN len(origins) = 1 THEN origins[1] END AS origin FROM bgps WHERE len <= CASE family WHEN 4 THEN 24 ELSE 48 END AND date IN (SELECT date FROM scoreds)),
m2 AS (SELECT date, family, net, bits, len, origin, source, method FROM methods UNION SELECT date, family, net, bits, len, origin, '{ALL}', method FROM methods),
per AS (SELECT m.source, m.method, b.family, b.date, b.net, b.len, b.origins, max(CASE WHEN b.origin = m.origin THEN 1 ELSE 0 END) AS ok FROM bb b JOIN m2 m ON m.date = b.date AND {inside("b", "m")} GROUP BY ALL)
SELECT family, source, method, (SELECT count(*) FROM bb WHERE bb.family = per.family) AS total, count(*) AS covered, CAST(sum(ok) AS BIGINT) AS valid FROM per GROUP BY 1, 2, 3"""),
    "q8_eval_active": with_inputs("scoreds", "bgps", body=f"""{METHODS}, act AS (SELECT m.family, m.source, m.method, count(DISTINCT (m.net, m.len, m.origin)) AS n FROM methods m
  JOIN bgps b ON len(b.origins) = 1 AND b.len <= CASE b.family WHEN 4 THEN 24 ELSE 48 END AND b.origins[1] = m.origin AND {inside("b", "m")}
   AND date_diff('day', strptime(CAST(b.date AS VARCHAR), '%Y%m%d'), strptime(CAST(m.date AS VARCHAR), '%Y%m%d')) BETWEEN 0 AND {LOOK_BACK - 1} GROUP BY 1, 2, 3),
tot AS (SELECT family, source, method, count(DISTINCT (net, len, origin)) AS total_cnt, count(DISTINCT (net, len)) AS total_prefix_cnt
  FROM (SELECT family, source, method, net, len, origin FROM methods UNION ALL SELECT family, source, 'IRR-ML', net, len, origin FROM judged WHERE yt = 1) WHERE origin IS NOT NULL GROUP BY 1, 2, 3)
SELECT family, source, method, coalesce(n, 0) AS active_cnt, total_cnt, total_prefix_cnt FROM tot LEFT JOIN act USING (family, source, method)"""),
    "q9_reduce_bgp": with_inputs("bgps", "nro_block", "nro_block6", "as_org", body=f""", days AS (SELECT DISTINCT CAST(strftime(date, '%Y%m%d') AS INT) AS date FROM irr),
bb AS (SELECT * FROM bgps WHERE date IN (SELECT date FROM days)),
near AS (SELECT d.date, arg_min(s.snapshot, struct_pack(a := abs(date_diff('day', strptime(CAST(d.date AS VARCHAR), '%Y%m%d'), strptime(CAST(s.snapshot AS VARCHAR), '%Y%m%d'))), b := s.snapshot)) AS snapshot
  FROM days d CROSS JOIN (SELECT DISTINCT snapshot FROM as_org) s GROUP BY 1),
orgs AS (SELECT n.date, a.asn, a.org, a.country FROM near n JOIN as_org a USING (snapshot)),
pw AS (SELECT list_transform(range(0, 33), lambda i: CAST(pow(2, 32 - i) AS BIGINT)) AS p),
four AS (SELECT DISTINCT date, net, len, CAST({first_unit("bits")} AS BIGINT) AS n FROM bb WHERE family = 4),
cuts AS (SELECT b.date, b.rir, b.start_ip, b.start_ip + b.num_ip AS stop, unnest(range(1, 33)) AS l FROM nro_block b),
hit4 AS (SELECT f.date, f.net, f.len, c.l, c.rir FROM four f JOIN cuts c ON c.date = f.date AND c.l <= f.len CROSS JOIN pw
  WHERE f.n // p[c.l + 1] * p[c.l + 1] >= c.start_ip AND (f.n // p[c.l + 1] + 1) * p[c.l + 1] <= c.stop
   AND NOT (f.n // p[c.l] * p[c.l] >= c.start_ip AND (f.n // p[c.l] + 1) * p[c.l] <= c.stop)),
hit6 AS (SELECT DISTINCT f.date, f.net, f.len, 32 AS l, n.rir FROM bb f JOIN nro_block6 n ON n.date = f.date AND f.family = 6 AND f.len >= 32 AND substr(f.net, 1, 8) = 'fd00' || lpad(split_part(n.prefix, ':', 2), 4, '0')),
rirs AS (SELECT date, net, len, arg_min(rir, struct_pack(a := l, b := rir)) AS rir FROM (SELECT * FROM hit4 UNION ALL SELECT * FROM hit6) GROUP BY 1, 2, 3)
SELECT b.date, r.rir, b.net, b.len, array_to_string(b.origins, '|') AS origins, string_agg(coalesce(g.org, ''), '|' ORDER BY b.i) AS isps,
  string_agg(coalesce(g.country, ''), '|' ORDER BY b.i) AS countries, b.total_cnt
FROM (SELECT *, unnest(range(1, len(origins) + 1)) AS i FROM bb) b LEFT JOIN rirs r ON r.date = b.date AND r.net = b.net AND r.len = b.len
LEFT JOIN orgs g ON g.date = b.date AND g.asn = b.origins[b.i] GROUP BY b.date, r.rir, b.net, b.len, b.origins, b.total_cnt"""),
    "q10_irr_validation": with_inputs("irrs", "vrps", "as_rel", body=f"""{RELATED} SELECT date, source, net, len, origin, isp,
  CASE WHEN NOT covered THEN 'unknown' WHEN hit THEN 'valid' ELSE 'invalid' END AS validation,
  CASE r WHEN 0 THEN 'same' WHEN 1 THEN 'sameISP' WHEN 2 THEN 'customer-provider' WHEN 3 THEN 'peering' WHEN 4 THEN 'ddos' WHEN 5 THEN 'none' ELSE 'not-covered' END AS sum_rel FROM ranked"""),
    "q11_active_irr": with_inputs("irrs", "vrps", "bgps", body=f"{ACTIVE} SELECT date, source, net, len, origin, validation FROM active"),
    "q12_active_merged": with_inputs("irrs", "vrps", "bgps", body=f"{MERGED} SELECT * FROM merged"),
    "q12_active_cdf": with_inputs("irrs", "vrps", "bgps", body=f"""{MERGED},
newest AS (SELECT * FROM validated WHERE date = (SELECT max(date) FROM irrs)),
registered AS (SELECT DISTINCT family, source, net, len, origin, validation FROM newest UNION SELECT DISTINCT family, '{ALL}', net, len, origin, validation FROM newest),
whole AS (SELECT family, source, count(*) AS n, count(*) FILTER (validation = 'valid') AS nv, count(*) FILTER (validation = 'invalid') AS ni FROM registered GROUP BY ALL),
days AS (SELECT DISTINCT family, source, latest_date FROM merged),
later AS (SELECT d.family, d.source, d.latest_date, m.validation, m.cnt FROM days d JOIN merged m ON m.family = d.family AND m.source = d.source AND m.latest_date >= d.latest_date)
SELECT l.family, l.source, l.latest_date, CAST(sum(cnt) FILTER (validation = 'total') AS BIGINT) AS irr, any_value(n) AS irr_total,
  CAST(coalesce(sum(cnt) FILTER (validation = 'valid'), 0) AS BIGINT) AS valid, any_value(nv) AS valid_total,
  CAST(coalesce(sum(cnt) FILTER (validation = 'invalid'), 0) AS BIGINT) AS invalid, any_value(ni) AS invalid_total
FROM later l LEFT JOIN whole w ON w.family = l.family AND w.source = l.source GROUP BY 1, 2, 3"""),
    "q13_irr_age_cdf": with_inputs("irrs", "vrps", body=f"""{VALIDATED}, aged AS (SELECT DISTINCT v.date, v.source, v.net, v.len, v.origin, v.validation, i.changed,
    date_diff('day', TRY_STRPTIME(CAST(i.changed AS VARCHAR), '%Y%m%d'), strptime(CAST(i.date AS VARCHAR), '%Y%m%d')) AS age
  FROM validated v JOIN irrs i ON i.date = v.date AND i.source = v.source AND i.net = v.net AND i.len = v.len AND i.origin = v.origin),
each AS (SELECT date, source, validation, age FROM aged WHERE age IS NOT NULL UNION ALL SELECT date, '{ALL}', validation, age FROM aged WHERE age IS NOT NULL),
rows2 AS (SELECT date, source, validation, age FROM each WHERE validation <> 'unknown' UNION ALL SELECT date, source, 'all', age FROM each),
f AS (SELECT date, source, validation, age, count(*) AS n FROM rows2 GROUP BY ALL)
SELECT a.date, a.source, a.validation, a.age, round(CAST(sum(b.n) FILTER (b.age <= a.age) AS DOUBLE) / CAST(sum(b.n) AS DOUBLE), 9) AS cdf
FROM f a JOIN f b ON a.date = b.date AND a.source = b.source AND a.validation = b.validation GROUP BY 1, 2, 3, 4"""),
    "q16_pr_curve": with_inputs("scoreds", body=f"{LABELLED}, {_KEPT} SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM {_curve('keepers')}"),
    "q16_auc_pr": with_inputs("scoreds", body=f"{LABELLED}, {_KEPT} SELECT 'all' AS records, round({_auc('labelled')}, 7) AS auc_pr UNION ALL SELECT 'kept', round({_auc('keepers')}, 7)"),
    "q17_transfer_label": with_inputs("scoreds", "transfers", "bgps", "irrs", body=f""", home AS (SELECT origin, min(isp) AS home FROM irrs WHERE isp IS NOT NULL AND isp <> 'None' GROUP BY 1),
rival AS (SELECT DISTINCT s.idx FROM scoreds s JOIN (SELECT DISTINCT net, len, unnest(origins) AS other FROM bgps) b ON b.net = s.net AND b.len = s.len AND b.other <> s.origin
  LEFT JOIN home h ON h.origin = b.other WHERE h.home IS DISTINCT FROM s.isp OR s.isp IS NULL),
hits AS (SELECT s.idx, s.isp, t.* FROM scoreds s JOIN transfers t ON {inside("s", "t")}
  WHERE s.record_type <> 'inactive' AND s.validation = 'unknown' AND NOT coalesce(t.from_isp = t.to_isp, false)
   AND NOT (coalesce(s.isp = t.to_isp, false) AND s.idx IN (SELECT idx FROM rival))),
pick AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY date DESC, len DESC, to_isp ASC NULLS FIRST, from_isp ASC NULLS FIRST) AS rn FROM hits)
SELECT idx, date AS transferred_date, from_isp, to_isp, CASE WHEN isp = to_isp THEN 1 ELSE 0 END AS label FROM pick WHERE rn = 1 AND (isp = to_isp OR isp = from_isp)"""),
    "q18_prefix_conflict": with_inputs("scoreds", body=""", o AS (SELECT date, net, len, origin, max(score1) AS s FROM scoreds WHERE score1 IS NOT NULL GROUP BY 1, 2, 3, 4),
g AS (SELECT date, net, len, count(*) AS n, sum(exp(s)) AS z FROM o GROUP BY 1, 2, 3)
SELECT o.date, o.net, o.len, o.origin, g.n AS n_origins, round(exp(o.s) / g.z, 6) AS share FROM o JOIN g USING (date, net, len) WHERE g.n > 1"""),
    "q18_origin_counts": with_inputs("scoreds", body="SELECT kind, count(*) AS n_prefixes FROM (SELECT CASE WHEN count(DISTINCT origin) > 1 THEN 'multiple' ELSE 'single' END AS kind FROM scoreds GROUP BY net, len) GROUP BY 1"),
}


def _percent(part: str, whole: str) -> str:
    return f"round(CASE WHEN {whole} = 0 THEN 0.0 ELSE 100.0 * {part} / {whole} END, 6)"


def _shares(query: str, part: str, whole: str) -> str:
    """Day and family with the percentages of the two kinds of registry."""
    return f"""WITH q AS ({query}), p AS (SELECT * FROM q WHERE source = 'VRP'), i AS (SELECT * FROM q WHERE source = '{ALL}')
SELECT date, family, coalesce({_percent("p." + part, "p." + whole)}, 0.0) AS rpki_pct, coalesce({_percent("i." + part, "i." + whole)}, 0.0) AS irr_pct
FROM (SELECT DISTINCT date, family FROM q) d LEFT JOIN p USING (date, family) LEFT JOIN i USING (date, family)"""


ORACLE |= {
    "q19_ip_coverage": _shares(ORACLE["q4_ip_coverage"], "total_cnt", "total_total"),
    "q19_as_coverage": _shares(ORACLE["q5_as_coverage"], "total_cnt", "total_total"),
    "q19_web_export": _shares(ORACLE["q1_bgp_coverage"], "covered", "total"),
    "q19_bgp_valid": _shares(ORACLE["q1_bgp_coverage"], "valid", "covered"),
    "q19_inconsistent_prefix": f"SELECT date, family, {_percent('discrepant', 'overlap')} AS irr_pct, discrepant AS irr_cnt FROM ({ORACLE['q3_inconsistent_prefix']}) WHERE source = '{ALL}'",
    "q19_inconsistent_bgp": f"SELECT date, family, {_percent('discrepant', 'both_covered')} AS irr_pct, discrepant AS irr_cnt FROM ({ORACLE['q2_inconsistent_bgp']})",
}
