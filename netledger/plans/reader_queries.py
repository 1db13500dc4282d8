"""Queries over landed files: tables are written in the form of each source and read back by its reader."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netledger.functions.ip import long_to_ipv4, net_hex
from netledger.plans import inputs as inp
from netledger.plans.composites import validated_routes
from netledger.plans.ingest import reduced_updates
from netledger.session import scratch, table
from netledger.sources import delegated, features, landing, mrt, networks, rows, rpsl
from netledger.streaming.incremental import daily_counts, run_available


def land(df: DataFrame, name: str) -> str:
    """Folder with the lines ``value`` of ``df`` in one folder ``file=NAME`` a file name."""
    path = scratch(df.sparkSession, name)
    df.select("file", "value").write.partitionBy("file").text(path)
    return path


def r_rpsl_files(s: SparkSession, d: str) -> DataFrame:
    """Registry dumps, one a day and registry."""
    t = table(s, d, "irr")
    key = F.when(F.col("prefix").contains(":"), "route6:  ").otherwise("route:   ")
    dated = F.when(F.col("changed").isNotNull(), F.concat(F.lit("changed:  x@example "), F.col("changed").cast("string"), F.lit("\n"))).otherwise("")
    value = F.concat(F.lit("% dump\n"), key, "prefix", F.lit("\ndescr:    a\n+ b\norigin:   AS"), F.col("origin").cast("string"), F.lit("\n"), dated, F.lit("mnt-by:   M\n"))
    path = land(t.select(F.concat_ws("_", inp.day_int("date").cast("string"), F.concat(F.lower("source"), F.lit(".db"))).alias("file"), value.alias("value")), "rpsl")
    got = rpsl.route_objects(rpsl.read_objects(s, path))
    return got.select("date", "source", F.concat_ws("/", "prefix_addr", F.col("prefix_len").cast("string")).alias("prefix"), "origin", "changed").distinct()


def _write_dump(keys: tuple, rows_of: pa.Table, folder: str) -> pa.Table:
    vantage, hour = (k.as_py() for k in keys)
    data = b"".join(mrt.encode_update(*r) for r in zip(*(rows_of.column(c).to_pylist() for c in ("second", "nlri", "origin"))))
    system, path = fs.FileSystem.from_uri(f"{folder}/{vantage}")
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/updates.{hour}.gz", compression=None) as out:
        out.write(gzip.compress(data, 1))
    return pa.table({"n": pa.array([len(data)], pa.int64())})


def landed_dumps(s: SparkSession, d: str) -> str:
    """Update dumps of each vantage point, one every eight hours."""
    t = table(s, d, "bgp_update").where("nlri is not null and origin is not null and ts is not null and vp is not null")
    second = F.unix_micros(F.col("ts").cast("timestamp"))
    t = t.select("vp", F.floor(second / 1_000_000).alias("second"), "nlri", "origin").where(F.col("origin").rlike(r"^(\d+|\{\d+(,\d+)*\})$"))
    folder = scratch(s, "mrt")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    hour = F.concat(F.date_format(F.timestamp_seconds("second"), "yyyyMMdd"), F.lpad((F.hour(F.timestamp_seconds("second")) / 8).cast("int").cast("string"), 2, "0"))
    written = t.withColumn("hour", hour).groupBy("vp", "hour").applyInArrow(lambda k, rows_of: _write_dump(k, rows_of, folder), "n long")
    written.agg(F.sum("n")).collect()
    return folder


def r_mrt_updates(s: SparkSession, d: str) -> DataFrame:
    return mrt.read_updates(s, landed_dumps(s, d))


def r_mrt_reduced(s: SparkSession, d: str) -> DataFrame:
    """Vantage points of each prefix and origins by day, over all files of a day."""
    r = reduced_updates(mrt.read_updates(s, landed_dumps(s, d)))
    return r.select("date", net_hex("net").alias("net"), "len", F.array_join(F.transform("origins", lambda x: x.cast("string")), "|").alias("origins"), "total_cnt")


def r_delegated_files(s: SparkSession, d: str) -> DataFrame:
    """Delegation statistics of both families and numbers, one file a registry and day."""
    b, six, a = inp.derived(s, d, "nro_block"), inp.derived(s, d, "nro_block6"), inp.derived(s, d, "nro_asn")
    lines = b.select("date", "rir", F.lit("ipv4").alias("kind"), long_to_ipv4("start_ip").alias("start"), F.col("num_ip").alias("n"))
    lines = lines.unionByName(six.select("date", "rir", F.lit("ipv6").alias("kind"), F.split_part("prefix", F.lit("/"), F.lit(1)).alias("start"), F.split_part("prefix", F.lit("/"), F.lit(2)).cast("long").alias("n")))
    lines = lines.unionByName(a.select("date", "rir", F.lit("asn").alias("kind"), F.col("asn_start").cast("string").alias("start"), F.col("num_asn").alias("n")))
    file = F.concat_ws("-", F.lit("delegated"), "rir", F.col("date").cast("string"))
    text = F.concat_ws("|", "rir", F.lit("ZZ"), "kind", "start", F.col("n").cast("string"), F.lit("20200101"), F.lit("allocated"))
    head = lines.select("rir", "date").distinct().select(file.alias("file"), F.concat_ws("|", "rir", F.lit("*"), F.lit("asn"), F.lit("*"), F.lit("1"), F.lit("summary")).alias("value"))
    r = delegated.read_delegated(s, land(lines.select(file.alias("file"), text.alias("value")).unionByName(head), "delegated"))
    nets = delegated.ipv4_prefixes(r).select("date", "rir", F.lit("ipv4").alias("kind"), F.concat_ws("/", long_to_ipv4("net"), F.col("len").cast("string")).alias("resource"))
    nets6 = delegated.ipv6_prefixes(r).select("date", "rir", F.lit("ipv6").alias("kind"), F.concat_ws("/", "prefix_addr", F.col("prefix_len").cast("string")).alias("resource"))
    return nets.unionByName(nets6).unionByName(delegated.numbers(r).select("date", "rir", F.lit("asn").alias("kind"), F.col("asn").cast("string").alias("resource")))


def r_as_org_files(s: SparkSession, d: str) -> DataFrame:
    """Organisation lists, two tables in one file a snapshot."""
    o = inp.derived(s, d, "as_org")
    orgs = F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", F.concat("org", "country"), F.lit("2020"), "org", "country", F.lit("X")))), "\n")
    nets = F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", F.col("asn").cast("string"), F.lit("2020"), F.lit("N"), F.concat("org", "country"), F.lit("z"), F.lit("X")))), "\n")
    text = F.concat(F.lit("# name: x\n# format:org_id|changed|org_name|country|source\n"), orgs, F.lit("\n# format:aut|changed|aut_name|org_id|opaque_id|source\n"), nets)
    path = land(o.groupBy("snapshot").agg(text.alias("value")).select(F.concat(F.col("snapshot").cast("string"), F.lit(".as-org2info.txt")).alias("file"), "value"), "as-org")
    return networks.read_as_org(s, path)


def r_as_rel_files(s: SparkSession, d: str) -> DataFrame:
    r = inp.derived(s, d, "as_rel")
    lines = r.select(F.concat(F.col("snapshot").cast("string"), F.lit(".as-rel.txt")).alias("file"), F.concat_ws("|", F.col("as1").cast("string"), F.col("as2").cast("string"), F.col("rel").cast("string")).alias("value"))
    return networks.read_as_rel(s, land(lines, "as-rel"))


def r_feature_lines(s: SparkSession, d: str) -> DataFrame:
    """Feature rows whose organisation may hold commas; inactive ones have no features."""
    t = table(s, d, "scored_irr").where("record_type is not null").dropDuplicates(["rec_id"])
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    lead = [inp.day_int("date").cast("string"), F.split_part("prefix", F.lit("/"), F.lit(1)), F.split_part("prefix", F.lit("/"), F.lit(2)), F.concat(F.col("origin").cast("string"), F.lit("# old"))]
    lead += [none("isp"), none("rir"), none("validation"), none("sum_rel"), none("source")]
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(features.FEATURES)), lambda i: (i + F.col("rec_id") % 7).cast("string")), ",")
    line = F.concat_ws(",", *lead, F.when(F.col("record_type") != "inactive", numbers))
    got = features.parse_feature_lines(t.select(line.alias("value")))
    total = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x)
    return got.select("date", "prefix_addr", "prefix_len", "origin", "isp", "rir", "source", "record_type", total.alias("total")).distinct()


def r_dump_lines(s: SparkSession, d: str) -> DataFrame:
    """Textual dumps of either form; announcements by sets go."""
    t = table(s, d, "bgp_update").where("nlri is not null and origin is not null and ts is not null")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    when = F.when(F.col("ann_id") % 2 == 0, second.cast("string")).otherwise(F.date_format(F.timestamp_seconds(second), "MM/dd/yy  HH:mm:ss"))
    line = F.concat_ws("|", "vp", F.lit("BGP4MP"), when, F.lit("A"), F.lit("1.1.1.1"), F.lit("9"), "nlri", F.concat(F.lit("9 "), F.col("origin")), F.lit("IGP"))
    return rows.dump_lines(t.select(line.alias("value"))).distinct()


def r_active_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of active objects in the newer and, of one registry, the older form."""
    v = inp.shown(validated_routes(s, d)).select("date", "source", "net", "len", "origin", "validation")
    old = F.concat_ws("\t", "net", F.col("len").cast("string"), F.col("origin").cast("string"), "validation", F.col("date").cast("string"))
    new = F.concat_ws("\t", F.col("date").cast("string"), "source", "net", F.col("len").cast("string"), F.col("origin").cast("string"), "validation")
    return rows.active_rows(v.select(F.when(F.col("source") == "RADB", old).otherwise(new).alias("value")))


def r_overlap_rows(s: SparkSession, d: str) -> DataFrame:
    """Nested records of overlapping objects; rows of IPv6 prefixes and partial overlaps go."""
    t = table(s, d, "irr").select(inp.day_int("date").alias("date"), "source", "prefix", "origin").distinct()
    nested = F.array_join(F.transform(F.array_sort(F.collect_set("origin")), lambda o: F.concat_ws(",", o.cast("string"), F.lit("8"), F.lit("x"), F.lit("y"))), "|")
    per = t.groupBy("date", "source", "prefix").agg(nested.alias("roas"), F.max("origin").alias("top"))
    rel = F.when(F.col("top") % 5 == 0, "partial").otherwise("same")
    lines = per.select(F.concat_ws("\t", F.col("date").cast("string"), "source", "prefix", rel, "roas", F.concat_ws(",", F.col("top").cast("string"), F.lit("a"), F.lit("b"))).alias("value"))
    text = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(r, ",")), "|")
    return rows.overlap_rows(lines).select("date", "source", "prefix", text("roa_records").alias("roa_records"), text("irr_records").alias("irr_records"))


def r_written_days(s: SparkSession, d: str) -> DataFrame:
    """A table written by day, one day written anew, and counted from the files."""
    t = table(s, d, "irr").select(inp.day_int("date").alias("date"), "source", "prefix", "origin").distinct()
    path = scratch(s, "days")
    landing.write_days(t, path)
    landing.write_days(t.where(F.col("date") == t.agg(F.max("date")).scalar()).withColumn("source", F.lit("ANEW")), path)
    return s.read.schema(t.schema).parquet(path).groupBy("date", "source").agg(F.count(F.lit(1)).alias("n")).select(F.col("date").cast("int").alias("date"), "source", "n")


def r_report_file(s: SparkSession, d: str) -> DataFrame:
    """A delimited report with a header, written and read by a declared schema; ``None`` is null."""
    t = table(s, d, "irr").groupBy("rir").agg(F.count(F.lit(1)).alias("n"))
    path = scratch(s, "report")
    landing.write_report(t, path, ["rir"])
    return s.read.schema("rir string, n long").option("header", True).option("nullValue", "None").csv(path)


def r_row_text(s: SparkSession, d: str) -> DataFrame:
    """Rows as delimited text with nested lists, missing values as ``None``."""
    t = table(s, d, "bgp_feature").dropDuplicates(["feat_id"]).where("size(updays) < 8 or updays is null")
    return t.select("feat_id", landing.row_text(["month", "prefix_addr", "updays"], t.schema).alias("line"))


def r_streamed_days(s: SparkSession, d: str) -> DataFrame:
    """Events landed in files, taken up as a stream of what is available, twice; the second run finds nothing new."""
    out, mark = scratch(s, "stream-out"), scratch(s, "stream-mark")
    source = table(s, d, "events")
    landed = scratch(s, "stream-in")
    source.repartition(3).write.parquet(landed)
    step = lambda df, n: daily_counts(df).write.mode("overwrite").parquet(f"{out}/batch={n}")
    for _ in range(2):
        run_available(s, landed, source.schema, mark, step).awaitTermination()
    return s.read.parquet(out).groupBy("day", "event_type").agg(F.sum("n").alias("n"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("r_") and callable(f)}

_DAY = "CAST(strftime(date, '%Y%m%d') AS INT)"
_ANNOUNCED = """u AS (SELECT DISTINCT vp AS vantage, CAST(strftime(ts, '%Y%m%d') AS INT) AS date, nlri, origin FROM bgp_update
  WHERE nlri IS NOT NULL AND origin IS NOT NULL AND ts IS NOT NULL AND vp IS NOT NULL AND regexp_full_match(origin, '[0-9]+|[{][0-9]+(,[0-9]+)*[}]'))"""


def _oracle() -> dict[str, str]:
    from netledger.plans.composites_sql import VALIDATED
    from netledger.plans.inputs import hex_text, with_inputs
    from netledger.plans.primitives_sql import ORACLE as SINGLE

    nro = SINGLE["q20_nro_expand"]
    head, _, tail = nro.partition("\nSELECT date, rir, 'ipv4'")
    six = with_inputs("nro_block6", body="").removeprefix("WITH ").strip()
    return {
        "r_rpsl_files": f"SELECT DISTINCT {_DAY} AS date, upper(source) AS source, prefix, origin, changed FROM irr",
        "r_mrt_updates": f"WITH {_ANNOUNCED} SELECT vantage, date, nlri AS prefix, origin FROM u",
        "r_mrt_reduced": f"""WITH {_ANNOUNCED} SELECT date, {hex_text("split_part(nlri, '/', 1)")} AS net, CAST(split_part(nlri, '/', 2) AS INT) AS len,
  array_to_string(list_sort(list_distinct(list_transform(string_split(replace(replace(origin, '{{', ''), '}}', ''), ','), lambda x: CAST(x AS BIGINT)))), '|') AS origins, count(DISTINCT vantage) AS total_cnt FROM u GROUP BY 1, 2, 3, 4""",
        "r_delegated_files": f"{head}, {six}\nSELECT date, rir, 'ipv4'{tail} UNION ALL SELECT date, rir, 'ipv6', prefix FROM nro_block6",
        "r_as_org_files": with_inputs("as_org", body="SELECT snapshot, asn, org, country FROM as_org"),
        "r_as_rel_files": with_inputs("as_rel", body="SELECT snapshot, as1, as2, rel FROM as_rel"),
        "r_feature_lines": f"""WITH one AS (SELECT DISTINCT ON (rec_id) * FROM scored_irr WHERE record_type IS NOT NULL)
SELECT DISTINCT {_DAY} AS date, split_part(prefix, '/', 1) AS prefix_addr, CAST(split_part(prefix, '/', 2) AS INT) AS prefix_len, origin, coalesce(isp, 'None') AS isp, coalesce(rir, 'None') AS rir, coalesce(source, 'None') AS source,
  CASE WHEN record_type = 'inactive' THEN 'inactive' WHEN validation = 'invalid' AND coalesce(sum_rel, 'None') <> 'none' THEN 'excluded' WHEN validation IN ('valid', 'invalid') THEN 'covered' ELSE 'not-covered' END AS record_type,
  CASE WHEN record_type <> 'inactive' THEN CAST(312 * 313 / 2 + 312 * (rec_id % 7) AS DOUBLE) END AS total FROM one""",
        "r_dump_lines": """SELECT DISTINCT vp AS vantage, CAST(strftime(ts, '%Y%m%d') AS INT) AS date, split_part(nlri, '/', 1) AS prefix_addr, CAST(split_part(nlri, '/', 2) AS INT) AS prefix_len, TRY_CAST(origin AS BIGINT) AS origin
FROM bgp_update WHERE nlri IS NOT NULL AND ts IS NOT NULL AND TRY_CAST(origin AS BIGINT) IS NOT NULL""",
        "r_active_rows": with_inputs("irrs", "vrps", body=VALIDATED + " SELECT date, source, net AS prefix_addr, len AS prefix_len, origin, validation FROM validated"),
        "r_overlap_rows": f"""WITH per AS (SELECT {_DAY} AS date, source, prefix, list_sort(list(DISTINCT origin)) AS os, max(origin) AS top FROM irr WHERE NOT contains(prefix, ':') GROUP BY 1, 2, 3)
SELECT date, unnest([source, 'ALL-IRR']) AS source, prefix, array_to_string(list_transform(os, lambda o: CAST(o AS VARCHAR) || ',8,x'), '|') AS roa_records, CAST(top AS VARCHAR) || ',a' AS irr_records FROM per WHERE top % 5 <> 0""",
        "r_written_days": f"""WITH t AS (SELECT DISTINCT {_DAY} AS date, source, prefix, origin FROM irr)
SELECT date, CASE WHEN date = (SELECT max(date) FROM t) THEN 'ANEW' ELSE source END AS source, count(*) AS n FROM t GROUP BY 1, 2""",
        "r_report_file": "SELECT rir, count(*) AS n FROM irr GROUP BY 1",
        "r_row_text": """WITH one AS (SELECT DISTINCT ON (feat_id) * FROM bgp_feature WHERE len(updays) < 8 OR updays IS NULL)
SELECT feat_id, CAST(month AS VARCHAR) || chr(9) || prefix_addr || chr(9) || CASE WHEN updays IS NULL THEN 'None' ELSE '[' || array_to_string(list_transform(updays, lambda x: coalesce(CAST(x AS VARCHAR), 'None')), ',') || ']' END AS line FROM one""",
        "r_streamed_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    }


ORACLE = _oracle()
