"""Typed inputs of the domain queries, each as a DataFrame and as DuckDB text.

Networks of both families are ``net`` (see :mod:`netledger.functions.ip`) and ``len``. The text form has
``net`` as hexadecimal digits, ``bits`` as text beside it, and compares leading bits, so it checks the engine's
masks and joins rather than repeating them.
Delegations, organisations and relationships have no table of their own; they are derived from
``supplier`` and ``part`` over the address and number ranges of the domain tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netledger.functions.ip import net4, net_hex, with_net
from netledger.operators.blocks import cidr_blocks
from netledger.session import table

#: Longest announcements that count, by family.
LONGEST = {4: 24, 6: 48}


def day_int(col) -> F.Column:
    return F.date_format(col, "yyyyMMdd").cast("int")


def not_too_specific(net: str = "net", length: str = "len") -> F.Column:
    return F.col(length) <= F.when(F.col(f"{net}.fam") == 4, LONGEST[4]).otherwise(LONGEST[6])


def shown(df: DataFrame) -> DataFrame:
    """Networks of a result as hexadecimal digits."""
    return df.withColumns({c: net_hex(c) for c, t in df.dtypes if t.startswith("struct<fam:")})


def irr(spark: SparkSession, d: str) -> DataFrame:
    """Route objects by snapshot: date, rir, net, len, origin, isp, country, source, changed."""
    t = with_net(table(spark, d, "irr"), "prefix")
    return t.select(day_int("date").alias("date"), "rir", "net", "len", "origin", "isp", "country", F.upper("source").alias("source"), "changed").distinct()


def irr_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "irr").select("date").distinct()


def snapshot_days(spark: SparkSession, d: str) -> F.Column:
    """All registry snapshot days as one array: thousands at most."""
    return table(spark, d, "irr").agg(F.array_sort(F.collect_set("date")).alias("days")).scalar()


def vrp(spark: SparkSession, d: str) -> DataFrame:
    """Payloads in force at each registry snapshot: date, uri, rir, net, len, max_len, origin, isp.

    The latest version of a uri that had begun by the day; equal days: the one known last. Versions follow
    each other, so each holds from its day to the next one's, and only those days are spelled out.
    """
    v = table(spark, d, "vrp").withColumn("p", F.concat_ws("/", "prefix_addr", F.col("prefix_len").cast("string")))
    last = with_net(v, "p").groupBy("uri", F.col("date").alias("since")).agg(F.max_by(F.struct("rir", "net", "len", "max_len", "origin", "isp"), "known_at").alias("v"))
    until = F.lead("since").over(Window.partitionBy("uri").orderBy("since"))
    held = last.withColumns({"until": until, "days": snapshot_days(spark, d)}).where(F.col("since").isNotNull())
    each = held.withColumn("date", F.explode(F.filter("days", lambda x: (x >= F.col("since")) & (F.col("until").isNull() | (x < F.col("until"))))))
    return each.select(
        day_int("date").alias("date"), "uri", F.col("v.rir").alias("rir"), F.col("v.net").alias("net"), F.col("v.len").alias("len"),
        F.coalesce("v.max_len", "v.len").alias("max_len"), F.col("v.origin").alias("origin"), F.col("v.isp").alias("isp"),
    )


def bgp(spark: SparkSession, d: str) -> DataFrame:
    """Announcements by day: date, net, len, origins (sorted array), total_cnt (vantage points)."""
    t = with_net(table(spark, d, "bgp_update").where(F.col("nlri").isNotNull() & F.col("origin").isNotNull()).select("date", "nlri", "origin", "vp"), "nlri")
    parts = F.transform(F.split(F.regexp_replace("origin", "[{}]", ""), ","), lambda x: F.trim(x).try_cast("long"))
    several = F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())))
    single = F.col("origin").try_cast("long")  # most are one number: no need to take a set apart
    origins = F.when(single.isNotNull(), F.array(single)).otherwise(several)
    rows = t.select(day_int("date").alias("date"), "net", "len", origins.alias("origins"), "vp")
    return rows.where(F.size("origins") > 0).groupBy("date", "net", "len", "origins").agg(F.countDistinct("vp").alias("total_cnt"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    t = with_net(table(spark, d, "scored_irr"), "prefix")
    return t.select(F.col("rec_id").alias("idx"), day_int("date").alias("date"), "net", "len", "origin", "isp", "validation", "record_type", "sum_rel", "source", "score0", "score1").distinct()


def transfer(spark: SparkSession, d: str) -> DataFrame:
    t = with_net(table(spark, d, "transfer").withColumn("p", F.concat_ws("/", "prefix_addr", F.col("prefix_len").cast("string"))), "p")
    name = lambda c: F.nullif(F.col(c), F.lit("None")).alias(c)
    return t.select(day_int("date").alias("date"), "net", "len", name("from_isp"), name("to_isp")).distinct()


def presence(spark: SparkSession, d: str) -> DataFrame:
    """Rows of bgp_feature with the days before the month's end on which the prefix was announced."""
    t = table(spark, d, "bgp_feature")
    return t.select("feat_id", "month", "prefix_addr", "prefix_len", "origin", "updays")


def delegated(spark: SparkSession, d: str) -> DataFrame:
    """Delegated networks of both families: date, net, len, rir."""
    four = cidr_blocks(derived(spark, d, "nro_block"), "start_ip", "num_ip").select("date", net4("net").alias("net"), "len", "rir")
    six = with_net(derived(spark, d, "nro_block6"), "prefix").select("date", "net", "len", "rir")
    return four.unionByName(six)


_RIR = "CASE CAST({k} % 5 AS INT) WHEN 0 THEN 'ripencc' WHEN 1 THEN 'apnic' WHEN 2 THEN 'arin' WHEN 3 THEN 'afrinic' ELSE 'lacnic' END"
# portable texts: {daily} is supplier with every snapshot day, {supplier}, {part} are tables, here and in DuckDB
DERIVED = {
    "nro_block": f"""SELECT day AS date, CAST(4026531840 + (s_suppkey * 37 % 640) * 4096 AS BIGINT) AS start_ip,
  CAST(4096 * (1 + s_suppkey % 5) + 256 * (s_suppkey % 3) AS BIGINT) AS num_ip, {_RIR.format(k="s_suppkey")} AS rir
FROM {{daily}} s""",
    "nro_asn": f"""SELECT day AS date, CAST(64512 + s_suppkey AS BIGINT) AS asn_start, CAST(1 + s_suppkey % 2 AS BIGINT) AS num_asn,
  CASE WHEN s_suppkey % 6 = 5 THEN 'jpnic' ELSE {_RIR.format(k="s_suppkey")} END AS rir
FROM {{daily}} s""",
    "nro_block6": f"""SELECT DISTINCT day AS date, CONCAT('fd00:', CAST(10 + s_suppkey % 6 AS STRING), '::/32') AS prefix, {_RIR.format(k="(s_suppkey % 6)")} AS rir
FROM {{daily}} s""",
    "as_org": """SELECT d.snapshot, CAST(64512 + s_suppkey * 11 % 420 AS BIGINT) AS asn,
  min('ORG_' || CAST((s_nationkey + CASE WHEN d.snapshot > 20230115 THEN 1 ELSE 0 END) % 25 AS STRING)) AS org, min('C' || CAST(s_nationkey AS STRING)) AS country
FROM (SELECT s_suppkey, s_nationkey, 20230101 AS snapshot FROM {supplier} UNION ALL SELECT s_suppkey, s_nationkey, 20230201 FROM {supplier}) d GROUP BY 1, 2""",
    "as_rel": """SELECT 20230101 AS snapshot, as1, as2, min(rel) AS rel
FROM (SELECT LEAST(a, b) AS as1, GREATEST(a, b) AS as2, rel
  FROM (SELECT CAST(64512 + p_partkey * 37 % 420 AS BIGINT) AS a, CAST(64512 + (p_partkey * 74 + 37) % 420 AS BIGINT) AS b,
               CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 0 END AS rel FROM {part}) p WHERE a <> b) q
GROUP BY as1, as2""",
}


def derived(spark: SparkSession, d: str, name: str) -> DataFrame:
    text = DERIVED[name]
    used = {t: table(spark, d, t) for t in ("supplier", "part") if f"{{{t}}}" in text}
    if "{daily}" in text:
        used["daily"] = table(spark, d, "supplier").select("s_suppkey", F.explode(snapshot_days(spark, d)).alias("day")).withColumn("day", day_int("day"))
    return spark.sql(text, **used)


_NIBBLES = "0000000100100011010001010110011110001001101010111100110111101111"


def hex_text(addr: str) -> str:
    """DuckDB text: the address of either family as hexadecimal digits; independent of the engine's form."""
    groups = f"list_filter(string_split(split_part({addr}, '::', PART), ':'), lambda x: x <> '')"
    left, right = groups.replace("PART", "1"), f"CASE WHEN contains({addr}, '::') THEN {groups.replace('PART', '2')} ELSE CAST([] AS VARCHAR[]) END"
    full = f"list_concat(list_concat({left}, list_transform(range(greatest(0, 8 - len({left}) - len({right}))), lambda i: '0')), {right})"
    hex6 = f"list_transform({full}, lambda x: lpad(lower(x), 4, '0'))"
    hex4 = f"list_transform(string_split({addr}, '.'), lambda x: format('{{:02x}}', TRY_CAST(x AS INT)))"
    return f"array_to_string(CASE WHEN contains({addr}, ':') THEN {hex6} ELSE {hex4} END, '')"


def bits_of_hex(hexed: str) -> str:
    return f"array_to_string(list_transform(string_split({hexed}, ''), lambda c: substr('{_NIBBLES}', 4 * instr('0123456789abcdef', c) - 3, 4)), '')"


def _addr(rows: str) -> str:
    """Rows with ``addr`` as rows with ``net``, ``bits`` and ``family``."""
    return f"(SELECT *, {bits_of_hex('net')} AS bits, CASE length(net) WHEN 8 THEN 4 ELSE 6 END AS family FROM (SELECT *, {hex_text('addr')} AS net FROM {rows}))"


_DAY = "CAST(strftime(date, '%Y%m%d') AS INT)"
_DAILY = "(SELECT s_suppkey, day FROM supplier CROSS JOIN (SELECT DISTINCT CAST(YEAR(date) * 10000 + MONTH(date) * 100 + DAY(date) AS INT) AS day FROM irr))"
_CUT = "split_part({0}, '/', 1) AS addr, CAST(split_part({0}, '/', 2) AS INT) AS len"

#: DuckDB text of each input as a common table expression
CTE = {
    "irrs": f"""irrs AS (SELECT date, rir, net, bits, family, len, origin, isp, country, source, changed FROM {_addr(f"""(SELECT DISTINCT {_DAY} AS date, rir, {_CUT.format("prefix")},
  origin, isp, country, upper(source) AS source, changed FROM irr)""")})""",
    "vrps": f"""vrps AS (SELECT {_DAY} AS date, uri, rir, net, bits, family, prefix_len AS len, coalesce(max_len, prefix_len) AS max_len, origin, isp
  FROM {_addr("""(SELECT i.date AS date, v.* EXCLUDE (date), v.prefix_addr AS addr, row_number() OVER (PARTITION BY i.date, v.uri ORDER BY v.date DESC, v.known_at DESC) AS rn
    FROM (SELECT DISTINCT date FROM irr) i JOIN vrp v ON v.date <= i.date)""")} WHERE rn = 1)""",
    "bgps": f"""bgps AS (SELECT date, net, bits, family, len, origins, count(DISTINCT vp) AS total_cnt FROM {_addr(f"""(
  SELECT {_DAY} AS date, {_CUT.format("nlri")}, vp,
    list_sort(list_distinct(list_filter(list_transform(string_split(replace(replace(origin, '{{', ''), '}}', ''), ','), lambda x: TRY_CAST(trim(x) AS BIGINT)), lambda x: x IS NOT NULL))) AS origins
  FROM bgp_update WHERE nlri IS NOT NULL AND origin IS NOT NULL)""")} WHERE len(origins) > 0 GROUP BY ALL)""",
    "scoreds": f"""scoreds AS (SELECT idx, date, net, bits, family, len, origin, isp, validation, record_type, sum_rel, source, score0, score1 FROM {_addr(f"""(SELECT DISTINCT rec_id AS idx, {_DAY} AS date, {_CUT.format("prefix")},
  origin, isp, validation, record_type, sum_rel, source, score0, score1 FROM scored_irr)""")})""",
    "transfers": f"""transfers AS (SELECT date, net, bits, family, len, from_isp, to_isp FROM {_addr(f"""(SELECT DISTINCT {_DAY} AS date, prefix_addr AS addr, prefix_len AS len, nullif(from_isp, 'None') AS from_isp, nullif(to_isp, 'None') AS to_isp
  FROM transfer)""")})""",
    "offs": "offs AS (SELECT DISTINCT feat_id, d FROM (SELECT feat_id, unnest(updays) AS d FROM bgp_feature) WHERE d BETWEEN 0 AND 364)",
}
CTE |= {n: f"{n} AS ({t.format(supplier='supplier', part='part', daily=_DAILY)})" for n, t in DERIVED.items()}


def with_inputs(*names: str, body: str) -> str:
    """``WITH`` the named inputs, then ``body``; a body may go on with further expressions after a comma."""
    return "WITH " + ",\n".join(CTE[n] for n in names) + (", " if body.lstrip().startswith(",") else "\n") + body.lstrip().removeprefix(",")
