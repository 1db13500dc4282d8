import bz2
import gzip
import json
import struct

from pyspark.sql import functions as F

from netledger.functions.ip import with_net
from netledger.plans.ingest import irr_table, reduced_updates, vrp_table
from netledger.sources import delegated, features, landing, mrt, networks, rpsl, transfers


def test_rpsl_objects(spark, tmp_path):
    text = (
        "route:      192.0.2.0/24 # remark\ndescr: a\n+ b\n\tc\norigin:     AS64500\nchanged: x@y 20200101\nchanged: x@y 20210203\nsource: T\n\n"
        "% comment\nroute6: 2001:db8::/\n 32\norigin: as64501 # old\nlast-modified: 2023-03-01T10:00:00Z\n\n"
        "route: 10.0.0.0/8\norigin: AS1\ncreated: 2019-01-02T00:00:00Z\n\nroute: 10.0.0.0/8\ndescr: no origin\n\nperson: x\n\n# EOF"
    )
    with gzip.open(tmp_path / "20230301_radb.db.gz", "wt") as f:
        f.write(text)
    objects = rpsl.read_objects(spark, str(tmp_path))
    got = {(r.date, r.source, r.prefix_addr, r.prefix_len, r.origin, r.changed) for r in rpsl.route_objects(objects).collect()}
    assert got == {
        (20230301, "RADB", "192.0.2.0", 24, 64500, 20210203),
        (20230301, "RADB", "2001:db8::", 32, 64501, 20230301),
        (20230301, "RADB", "10.0.0.0", 8, 1, 20190102),
    }
    first = objects.where(F.col("value").contains("192.0.2")).select(rpsl.attributes("value").alias("a")).select(rpsl.first_value("a", "descr"), F.size(rpsl.all_values("a", "changed"))).first()
    assert tuple(first) == ("a\nb\nc", 2)


def test_delegations(spark, tmp_path):
    lines = [
        "2|apnic|20230301|9|19830613|20230228|+1000", "apnic|*|ipv4|*|3|summary", "# c", "apnic|AU|ipv4|1.0.0.0|768|20110811|assigned|A1", "apnic|JP|asn|1.5|2|20020801|allocated",
        "apnic|JP|ipv6|2001:200::|35|19990813|allocated|A2", "apnic|JP|ipv4|bad|256|19990813|allocated",
    ]
    (tmp_path / "delegated-apnic-20230301.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    d = delegated.read_delegated(spark, str(tmp_path))
    assert {(r.net, r.len, r.date) for r in delegated.ipv4_prefixes(d).collect()} == {(1 << 24, 23, 20230301), ((1 << 24) + 512, 24, 20230301)}
    assert {r.asn for r in delegated.numbers(d).collect()} == {65541, 65542}
    assert [(r.prefix_addr, r.prefix_len) for r in delegated.ipv6_prefixes(d).collect()] == [("2001:200::", 35)]


def test_network_snapshots(spark, tmp_path):
    (tmp_path / "20230101.as-org2info.txt").write_text(
        "# name: x\n# format:org_id|changed|org_name|country|source\nO1|20200101|Org One|US|ARIN\nO2|2020||DE|RIPE\n"
        "# format:aut|changed|aut_name|org_id|opaque_id|source\n1|20200101|N|O1|z|ARIN\n2|2020|N|O2|z|RIPE\n3|2020|N|O9|z|RIPE\n"
    )
    got = {(r.snapshot, r.asn, r.org, r.country) for r in networks.read_as_org(spark, str(tmp_path)).collect()}
    assert got == {(20230101, 1, "Org One", "US"), (20230101, 2, None, "DE"), (20230101, 3, None, None)}
    rel = tmp_path / "rel"
    rel.mkdir()
    (rel / "20230101.as-rel.txt").write_text("# c\n1|2|-1\n3|4|0\nbad|5|0\n")
    assert {(r.as1, r.as2, r.rel) for r in networks.read_as_rel(spark, str(rel)).collect()} == {(1, 2, -1), (3, 4, 0)}


def test_transfers(spark, tmp_path):
    nets = [{"transfer_set": [{"start_address": "10.0.0.0", "end_address": "10.0.0.255"}, {"start_address": "10.1.2.3", "end_address": "10.1.2.3"}, {"start_address": "2001::", "end_address": "2001::1"}]}]
    log = {"type": "T", "transfer_date": "2023-01-02T00:00:00Z", "source_rir": "RIPE NCC", "recipient_rir": "ARIN", "source_organization": {"name": "A"}, "ip4nets": nets}
    single = log | {"ip4nets": nets[0], "recipient_organization": {"name": "B"}}
    (tmp_path / "t.json").write_text(json.dumps({"transfers": [log, single, {k: v for k, v in log.items() if k != "ip4nets"}]}, indent=1))
    got = sorted(tuple(r) for r in transfers.read_transfers(spark, str(tmp_path)).fillna("-").collect())
    base = [("10.0.0.0", 24), ("10.1.2.3", 32)]
    assert got == sorted((20230102, a, n, "RIPE", "A", "ARIN", to, "T") for a, n in base for to in ("-", "B"))


def test_ragged_features(spark):
    lead = ["20230301", "10.0.0.0", "8", "64500#x", "Org", "arin", "valid", "same", "RADB"]
    numbers = [str(i) for i in range(312)]
    lines = [",".join(lead), ",".join(lead + numbers), ",".join(lead[:4] + ["Org", " Inc", " Ltd"] + lead[5:] + numbers), "a,b", None, ",".join(["x"] + lead[1:])]
    got = features.parse_feature_lines(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("isp", "record_type").collect()
    assert [(r.isp, r.origin, r.source, r.record_type, r.features and len(r.features)) for r in got] == [
        ("Org", 64500, "RADB", "covered", 312), ("Org", 64500, "RADB", "inactive", None), ("Org, Inc, Ltd", 64500, "RADB", "covered", 312),
    ]


def attribute(kind, value):
    return bytes([0x40, kind, len(value)]) + value


def record(update, second=1677628800, subtype=4, kind=16):
    width = 4 if subtype == 4 else 2
    message = b"\xff" * 16 + struct.pack(">HB", 19 + len(update), 2) + update
    body = (b"\0\0\0\0" if kind == 17 else b"") + bytes(2 * width) + b"\0\0\0\1" + bytes(8) + message
    return struct.pack(">IHHI", second, kind, subtype, len(body)) + body


def update(attrs, nlri):
    return b"\0\0" + struct.pack(">H", len(attrs)) + attrs + nlri


def test_mrt(spark, tmp_path):
    seq = lambda *n, w=4: bytes([2, len(n)]) + b"".join(x.to_bytes(w, "big") for x in n)
    two = bytes([24, 192, 0, 2, 8, 10])
    plain = record(update(attribute(1, b"\0") + attribute(2, seq(1, 64500)), two))
    as_set = record(update(attribute(2, seq(1) + bytes([1, 2]) + (7).to_bytes(4, "big") + (8).to_bytes(4, "big")), bytes([8, 11])), kind=17)
    old = record(update(attribute(17, seq(1, 70000)) + attribute(2, seq(1, 23456, w=2)), bytes([8, 12])), subtype=1)
    six = record(update(attribute(2, seq(9)) + attribute(14, b"\0\2\1\4" + bytes(4) + b"\0" + bytes([32, 0x20, 1, 0x0D, 0xB8])), b""))
    keepalive = struct.pack(">IHHI", 0, 16, 4, 4) + bytes(4)
    data = plain + as_set + keepalive + plain + old + six + plain[:20]
    (tmp_path / "updates.gz").write_bytes(gzip.compress(data))
    got = {(r.date, r.prefix, r.origin) for r in mrt.read_updates(spark, str(tmp_path)).collect()}
    day = 20230301
    assert got == {(day, "192.0.2.0/24", "64500"), (day, "10.0.0.0/8", "64500"), (day, "11.0.0.0/8", "{7,8}"), (day, "12.0.0.0/8", "70000"), (day, "2001:db8::/32", "9")}
    reduced = {(r.net.hi, tuple(r.origins), r.total_cnt) for r in reduced_updates(mrt.read_updates(spark, str(tmp_path))).collect()}
    assert (11 << 56, (7, 8), 1) in reduced and (0x20010DB800000000, (9,), 1) in reduced and len(reduced) == 5


def test_hours_of_a_vantage_point_are_one(spark, tmp_path):
    seq = bytes([2, 1]) + (64500).to_bytes(4, "big")
    two = lambda day: record(update(attribute(2, seq), bytes([24, 192, 0, 2])), second=1677628800 + day)
    for vantage in ("route-views.a", "route-views.b"):
        folder = tmp_path / vantage / "2023.03" / "UPDATES"
        folder.mkdir(parents=True)
        for hour in range(3 if vantage.endswith("a") else 1):
            (folder / f"updates.20230301.{hour:02}00.gz").write_bytes(gzip.compress(two(3600 * hour)))
    rows = mrt.read_updates(spark, str(tmp_path))
    assert {tuple(r) for r in rows.collect()} == {(v, 20230301, "192.0.2.0/24", "64500") for v in ("route-views.a", "route-views.b")}
    assert [r.total_cnt for r in reduced_updates(rows).collect()] == [2]


def test_merged_paths():
    assert mrt.merged_path(["1", "23456", "23456"], ["70000", "70001"]) == ["1", "70000", "70001"]
    assert mrt.merged_path(["1"], []) == ["1"] and mrt.merged_path(["1"], ["2", "3"]) == ["1"]


def test_file_names(spark):
    names = ["20230301_radb.db.gz", "vrps-2023-04-01.csv", "nodate.txt", "20230301_ripe.db.route.gz"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(landing.file_day(F.col("n")), landing.file_source(F.col("n"))).collect()
    assert got[0][:] == (20230301, "RADB") and got[1][0] == 20230401 and got[2][0] is None


def test_sinks_and_ingestion(spark, tmp_path):
    objects = spark.createDataFrame([(20230301, "RADB", "10.1.0.0", 16, 5, 20200101), (20230301, "RADB", "fd00::", 8, 6, None)], "date int, source string, prefix_addr string, prefix_len int, origin long, changed int")
    blocks = with_net(spark.createDataFrame([(20230301, "10.0.0.0/8", "arin"), (20230301, "fc00::/7", "apnic")], "date int, p string, rir string"), "p").drop("p")
    orgs = spark.createDataFrame([(20230301, 5, "Org", "US")], "date int, asn long, org string, country string")
    rows = irr_table(objects, blocks, orgs)
    assert {(r.rir, r.prefix, r.isp) for r in rows.collect()} == {("arin", "10.1.0.0/16", "Org"), ("apnic", "fd00::/8", None)}
    roas = spark.createDataFrame([(20230301, "rsync://rpki.ripe.net/x.roa", "10.1.0.0", 16, None, 5)], "date int, uri string, prefix_addr string, prefix_len int, max_len int, origin long")
    assert tuple(vrp_table(roas, blocks, orgs).select("rir", "max_len", "num_ip", "isp").first()) == ("ripencc", 16, 65536, "Org")
    landing.write_days(rows, str(tmp_path / "days"))
    landing.write_days(rows.withColumn("origin", F.lit(9)).where("rir = 'arin'"), str(tmp_path / "days"))
    assert spark.read.parquet(str(tmp_path / "days")).select("origin").distinct().count() == 1
    landing.write_report(rows.select("prefix", "origin"), str(tmp_path / "report"), ["prefix"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "report")).collect()] == [("10.1.0.0/16", "5"), ("fd00::/8", "6")]


def test_text_rows(spark):
    from netledger.sources import rows

    one = lambda f, *lines: [tuple(r) for r in f(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    dumps = ("v1|BGP4MP|1677628800|A|1.1.1.1|9|10.0.0.0/8|9 64500|IGP", "BGP4MP|03/02/23  10:00:00|A|1.1.1.1|9|10.0.0.0/8|9 1.5|IGP|x", "v|BGP4MP|1|A|p|9|10.0.0.0/8|9 {1,2}|IGP", "short|x", None)
    assert one(rows.dump_lines, *dumps) == [("v1", 20230301, "10.0.0.0", 8, 64500), ("verbose", 20230302, "10.0.0.0", 8, 65541)]
    assert one(rows.active_rows, "10.0.0.0\t8\t5\tvalid\t20230301", "20230301\tRIPE\t10.0.0.0\t8\t5\tinvalid", "a\tb") == [
        (20230301, "RADB", "10.0.0.0", 8, 5, "valid"), (20230301, "RIPE", "10.0.0.0", 8, 5, "invalid"),
    ]
    got = one(rows.overlap_rows, "20230301\t10.0.0.0/8\tsame\ta,8,8,5|b,9,9,6\tc,5,x", "20230301\tRIPE\t10.0.0.0/8\tpartial\ta\tb")
    assert got == [(20230301, s, "10.0.0.0/8", [["a", "8", "8"], ["b", "9", "9"]], [["c", "5"]]) for s in ("RADB", "ALL-IRR")]


def test_due_months(spark):
    from netledger.streaming.incremental import due_months

    days = spark.createDataFrame([(20230105,), (20230207,), (20230301,)], "date int")
    assert [r.month for r in due_months(days, spark.createDataFrame([(202301,)], "month int")).collect()] == [202302]


def test_encoded_updates_are_decoded():
    rows = [(1677628800, "10.1.0.0/16", "64500"), (1677628801, "fd00:12::/32", "4200000000"), (1677628802, "0.0.0.0/0", "{7,8}")]
    assert list(mrt.announcements(b"".join(mrt.encode_update(*r) for r in rows))) == rows


def test_rows_as_text(spark):
    df = spark.createDataFrame([(1, None, [1, None, 2]), (2, "x", None), (3, "", [])], "a int, b string, c array<int>")
    got = [r[0] for r in df.orderBy("a").select(landing.row_text(["a", "b", "c"], df.schema, ",")).collect()]
    assert got == ["1,None,[1,None,2]", "2,x,None", "3,,[]"]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    import pytest

    from netledger import session

    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "x"

    with pytest.raises(RuntimeError):
        session.shared_dir(Elsewhere)
    Elsewhere.sparkContext.master = "local[4]"
    assert session.shared_dir(Elsewhere).startswith("file://")
    assert session.scratch(spark, "x").startswith(session.shared_dir(spark))


def test_command_line(spark, tmp_path, capsys):
    from netledger.__main__ import main
    from tests.conftest import DATA

    assert main(["--list"]) == 0 and "q1_bgp_coverage" in capsys.readouterr().out
    assert main(["nothing"]) == 2
    assert main(["q4_ip_coverage", DATA, str(tmp_path / "a"), "--ip-version", "6", "--start", "20230101"], spark) == 0
    rows = spark.read.option("header", True).csv(str(tmp_path / "a")).collect()
    assert rows and {r.family for r in rows} == {"6"} and min(r.date for r in rows) > "20230101"
    assert main(["q3_inconsistent_prefix", DATA, str(tmp_path / "b"), "--format", "parquet", "--end", "20230301"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "b")).agg(F.max("date")).first()[0] <= 20230301
