import datetime
import ipaddress
import random

import numpy as np
from pyspark.sql import functions as F

from netledger.functions import bits, ip
from netledger.operators.activity import METRICS, SPAN, WINDOWS, feature_names, month_bitmaps, run_metrics, runs, wide_features, year_presence
from netledger.operators.asof import nearest_snapshot
from netledger.operators.blocks import cidr_blocks, covered_space
from netledger.operators.cover import cover_join
from netledger.operators.registry import directed_edges, validate_origin, validated_relations
from netledger.operators.scoring import auc_pr, pr_curve, softmax1


def test_address_functions(spark):
    rows = [("10.0.0.1", "10.0.0.254"), ("255.255.255.255", "255.255.255.255"), ("1.2.3", "256.1.1.1"), (None, "a.b.c.d")]
    df = spark.createDataFrame(rows, "a string, b string").select(ip.ipv4_to_long("a").alias("a"), ip.ipv4_to_long("b").alias("b"))
    got = [tuple(r) for r in df.select("a", ip.long_to_ipv4("a"), ip.common_prefix_len("a", "b")).collect()]
    assert got == [(167772161, "10.0.0.1", 24), (4294967295, "255.255.255.255", 32), (None, "", None), (None, "", None)]
    asn = spark.createDataFrame([("AS1.5",), ("as64500",), ("7",), ("x",), (None,)], "t string").select(ip.asn_to_long("t")).collect()
    assert [r[0] for r in asn] == [65541, 64500, 7, None, None]


def test_prefixes_of_both_families(spark):
    texts = ["10.1.0.0/16", "2001:db8::/32", "::1/128", "fe80::1:2/64", "10.0.0.0/33", "1::2::3/8", "x", None, "10.0.0/8"]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    got = {r.p: (r.fam, r.hi, r.lo, r.len) for r in ip.with_prefix(df, "p").collect()}
    assert got["10.1.0.0/16"] == (4, 0x0A010000 << 32, 0, 16)
    assert got["2001:db8::/32"] == (6, 0x20010DB800000000, 0, 32)
    assert got["::1/128"] == (6, 0, 1, 128)
    assert got["fe80::1:2/64"] == (6, 0xFE80000000000000 - 2**64, 0x10002, 64)
    assert set(got) <= set(texts[:4]) | {"1::2::3/8"}


def nets(spark, rows, extra=""):
    """Rows whose first column is a prefix as text, with ``net, len``; null prefixes keep nulls."""
    df = spark.createDataFrame(rows, f"p string{extra}")
    six = ip.with_net(df, "p")
    return six.unionByName(df.where("p is null").withColumns({"net": F.lit(None).cast(six.schema["net"].dataType), "len": F.lit(8)}))


def test_address_text_of_both_families(spark):
    rng = random.Random(3)
    texts = {str(ipaddress.ip_address(rng.getrandbits(128) & rng.choice([-1, (1 << 128) - (1 << 64), 0xFFFF << 96 | 0xFF00FF, 0xFFFF << 48]))) for _ in range(60)} | {"::", "::1", "1::", "10.0.0.255"}
    got = nets(spark, [(f"{ipaddress.ip_address(t)}/8",) for t in texts if t != "x"]).select(ip.address_text("net").alias("a"), ip.net_hex("net").alias("h"), ip.prefix_text("net", "len").alias("t")).collect()
    want = {str(a): a.packed.hex() for a in (ipaddress.ip_address(t) for t in texts) if "." not in str(a) or a.version == 4}
    assert {r.a: r.h for r in got} == want and all(r.t == f"{r.a}/8" for r in got)


def test_cover_join_matches_containment(spark):
    rng = random.Random(7)

    def make(n, least):
        out = []
        for _ in range(n):
            four = rng.random() < 0.6
            width, k = (32, rng.randrange(least, 33)) if four else (128, rng.choice([least, 16, 40, 48, 64, 65, 128]))
            bits = rng.getrandbits(width) & (0x0F03FFFF if four else (0xF << 120 | 0x3 << 78 | 0x3 << 60 | 0xFF)) | (0x0A << 24 if four else 0xFD << 120)
            out.append(str(ipaddress.ip_network((bits >> (width - k) << (width - k), k))))
        return out

    probe, dim = make(200, 0), make(120, 0) + ["0.0.0.0/0", "::/0", "255.0.0.0/8", "8000::/1"]
    p = nets(spark, [(x, 1) for x in sorted(set(probe))] + [(None, 1)], ", date int")
    d = nets(spark, [(x, 1, x) for x in dim * 2] + [("10.0.0.0/1", 2, "other"), (None, 1, "null")], ", date int, name string").drop("p")
    inside = lambda a, b: ipaddress.ip_network(a).version == ipaddress.ip_network(b).version and ipaddress.ip_network(a).subnet_of(ipaddress.ip_network(b))
    for default, least in ((False, 1), (True, 0)):
        want = {(a, b) for a in probe for b in dim if inside(a, b) and ipaddress.ip_network(b).prefixlen >= least}
        got = [(r.p, r.c_name) for r in cover_join(p, d, ["date"], default_route=default, measured=default).collect()]
        assert set(got) == want and len(got) == len(want)
    left = cover_join(p, d, ["date"], how="left").collect()
    assert {(r.p, r.c_name) for r in left if r.c_name} == {(a, b) for a, b in want if not b.endswith("/0")} and {r.p for r in left} == {*probe, None}


def test_validation_and_relations(spark):
    routes = nets(spark, [("10.0.0.0/16", 1, 5, "x"), ("10.0.0.0/24", 1, 5, None), ("11.0.0.0/8", 1, 5, "x"), ("fd00::/32", 1, 6, None)], ", date int, origin long, isp string").drop("p")
    roas = nets(spark, [("10.0.0.0/8", 1, 5, 16, None), ("10.0.0.0/8", 1, 6, 32, "x"), ("fd00::/16", 1, 6, 48, None)], ", date int, origin long, max_len int, isp string").drop("p")
    keys = ["date", "net", "len", "origin", "isp"]
    assert {(r.len, r.validation) for r in validate_origin(routes, roas, keys).collect()} == {(16, "valid"), (24, "invalid"), (8, "unknown"), (32, "valid")}
    edges = directed_edges(spark.createDataFrame([(5, 6, -1)], "as1 long, as2 long, rel int"))
    got = {(r.len, r.validation, r.sum_rel) for r in validated_relations(routes, roas, edges, keys).collect()}
    assert got == {(16, "valid", "same"), (24, "invalid", "customer-provider"), (8, "unknown", "not-covered"), (32, "valid", "same")}


def test_cidr_blocks_are_aligned_and_complete(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(2**31), rng.randrange(1, 5000)) for i in range(60)] + [(100, 0, 2**32), (101, 5, 0), (102, 5, None), (103, 2**32 - 3, 3)]
    got = {}
    for r in cidr_blocks(spark.createDataFrame(rows, "i int, s long, n long"), "s", "n").collect():
        got.setdefault(r.i, []).append((r.net, 2 ** (32 - r.len)))
    for i, s, n in rows:
        at = s
        for net, size in sorted(got.get(i, [])):
            assert net == at and net % size == 0
            at += size
        assert at == s + (n or 0)
        sizes = [x for _, x in sorted(got.get(i, []))]
        assert all(len([1 for x in sizes if x == k]) <= 2 for k in sizes)  # the least set has at most two of a size


def test_covered_space(spark):
    rows = [("0.0.0.0/1", "a"), ("0.0.0.0/8", "a"), ("0.0.0.0/8", "a"), ("10.0.0.0/8", "b"), ("10.1.0.0/16", "b"), ("11.0.0.0/32", "b"), ("0.0.0.0/0", "c"), (None, "d"), ("240.0.0.0/13", "e"), ("240.8.0.0/13", "e")]
    rows += [("fd00:1::/48", "b"), ("fd00:1::/32", "b"), ("fd00:2::1/128", "b"), ("fd00:2::/65", "b"), ("::/8", "c"), ("8000::/16", "c"), ("ff00::/8", "e")]
    got = {(r.k, r.family): r.num_ip for r in covered_space(nets(spark, rows, ", k string"), ["k"]).collect()}
    assert got == {
        ("a", 4): 2**31, ("b", 4): 2**24 + 1, ("c", 4): 2**32, ("e", 4): 2**20, ("b", 6): 2**32 + 1, ("c", 6): 2**56 + 2**48, ("e", 6): 2**56,
    }


def test_nearest_snapshot(spark):
    days = spark.createDataFrame([(20230101,), (20230115,), (20230116,), (20230117,), (20230301,), (None,), (20231399,)], "date int")
    snaps = spark.createDataFrame([(20230101,), (20230131,), (20230131,)], "snapshot int")
    got = dict(tuple(r) for r in nearest_snapshot(days, snaps).collect())
    assert got == {20230101: 20230101, 20230115: 20230101, 20230116: 20230101, 20230117: 20230131, 20230301: 20230131}
    assert nearest_snapshot(days, snaps.limit(0)).collect() == []


def loop_metrics(days):
    """The 13 metrics of each window by walking the days."""
    up = [i in days for i in range(SPAN)]
    out = {}
    for w in WINDOWS:
        reach = min(w, SPAN)
        seq, lengths = up[:reach], {True: [], False: []}
        start = 0
        for i in range(1, reach + 1):
            if i == reach or seq[i] != seq[start]:
                if not (w > SPAN and i == SPAN):
                    lengths[seq[start]].append(i - start)
                start = i
        here = [i for i in range(reach) if seq[i]]
        life = max(here) - min(here) + 1 if here else 0
        row = [len(here) / w, life / w, len(here) / life if life else 0.0]
        row += [sum(a and not b for a, b in zip(seq, seq[1:])), sum(b and not a for a, b in zip(seq, seq[1:]))]
        for side in (True, False):
            v = lengths[side] or [0]
            row += [min(v), max(v), float(np.mean(v)), float(np.std(v))]
        out[w] = row
    return out


def test_run_metrics_match_a_loop(spark):
    rng = random.Random(9)
    sets = {1: [], 2: [0], 3: [364], 4: list(range(SPAN)), 5: [0, 364], 6: sorted(rng.sample(range(SPAN), 60)), 7: [*range(10, 50), *range(300, 365)]}
    rows = [(k, [*v, *v[:3], -1, 365, None]) for k, v in sets.items()] + [(1, None)]
    m = run_metrics(spark.createDataFrame(rows, "id int, days array<int>"), "id", "days")
    got = {(r["id"], r["wnd"]): [r[c] for c in METRICS] for r in m.collect()}
    for k, days in sets.items():
        for w, want in loop_metrics(set(days)).items():
            assert np.allclose(got[k, w], want), (k, w)
    wide = wide_features(m, "id")
    assert wide.columns[1:] == feature_names() and len(feature_names()) == 312 and wide.count() == len(sets)


def test_runs_sum_to_the_year(spark):
    r = runs(spark.createDataFrame([(1, [3, 4, 9]), (2, None)], "id int, days array<int>"), "id", "days")
    assert {tuple(x) for x in r.groupBy("id").agg(F.sum(F.col("stop") - F.col("start") + 1)).collect()} == {(1, SPAN), (2, SPAN)}


def test_month_bitmaps(spark):
    rows = [("p", "2023-02-01"), ("p", "2023-02-03"), ("p", "2023-02-03"), ("p", "2023-03-31"), ("p", None)]
    df = spark.createDataFrame(rows, "p string, d string").withColumn("d", F.to_date("d"))
    got = {r.month: (r.bits, r.bit_text) for r in month_bitmaps(df, ["p"], "d").collect()}
    assert got == {202302: (5, "0" * 25 + "101"), 202303: (2**30, "1" + "0" * 30)}


def test_curve_and_area(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, None), (None, 0.5)]
    c = pr_curve(spark.createDataFrame(rows, "y int, s double"), "y", "s")
    got = {r.threshold: (round(r.precision, 4), r.recall) for r in c.collect()}
    assert got == {0.9: (1.0, 0.5), 0.8: (0.6667, 1.0), 0.1: (0.5, 1.0)}
    assert abs(auc_pr(c).first()[0] - (0.5 + 0.5 * (1 + 2 / 3) / 2)) < 1e-9
    big = spark.createDataFrame([(-800.0, 800.0), (800.0, -800.0)], "a double, b double").select(softmax1("a", "b")).collect()
    assert [r[0] for r in big] == [1.0, 0.0]


def test_year_presence_joins_months(spark):
    rng = random.Random(11)
    rows = [(k, f"2023-{m:02}-{d:02}") for k in "ab" for m in range(1, 13) for d in range(1, 29) if rng.random() < (0.2 if k == "a" else 0.02)] + [("a", "2022-01-31"), ("c", "2024-02-29"), ("a", None)]
    df = spark.createDataFrame(rows, "p string, d string").withColumn("d", F.to_date("d"))
    got = {(r.p, r.month): r.updays for r in year_presence(month_bitmaps(df, ["p"], "d"), ["p"]).collect()}
    want = {}
    for k in "abc":
        mine = [datetime.date.fromisoformat(d) for p, d in rows if p == k and d]
        for month in range(12 * 2022, 12 * 2024 + 2):
            end = datetime.date(month // 12 + (month % 12 == 11), (month + 1) % 12 + 1, 1) - datetime.timedelta(1)
            back = sorted({(end - x).days for x in mine if 0 <= (end - x).days < SPAN})
            if back:
                want[k, end.year * 100 + end.month] = back
    assert got == want
    empty = month_bitmaps(df.limit(0), ["p"], "d")
    assert year_presence(empty, ["p"]).collect() == []


def test_bit_vectors(spark):
    rows = [(0, 30), (1, 28), (5, 31), (2**27 + 2**8 + 3, 28), (2**31 - 1, 31)]
    df = spark.createDataFrame([(b, n, format(b, f"0{n}b")) for b, n in rows], "b long, n int, t string")
    got = df.select("b", "n", bits.from_text("t"), bits.words("b", 8, 4), bits.from_words(bits.words("b", 8, 4), 8), bits.shifted("b", 3, F.col("n")), bits.shifted("b", 2, F.col("n"), 1)).collect()
    for b, n, text, words, again, later, filled in got:
        assert text == b == again and words == "|".join(str(b >> 8 * i & 255) for i in range(4))
        assert later == b << 3 & (1 << n) - 1 and filled == (b << 2 & (1 << n) - 1) | 3


def test_merging_active_objects_again_changes_nothing(spark):
    from netledger.plans.composites import AKEY, merge_active

    kinds = "source string, net long, len int, origin long, validation string, "
    state = spark.createDataFrame([("A", 1, 8, 5, "valid", 20230101), ("A", 1, 8, 5, "invalid", 20230103)], kinds + "latest_date int")
    day = spark.createDataFrame([("A", 1, 8, 5, "valid", 20230102), ("B", 2, 8, 5, "unknown", 20230102)], kinds + "date int")
    once = merge_active(state, day)
    want = {("valid", 20230102), ("invalid", 20230103), ("unknown", 20230102)}
    assert {(r.validation, r.latest_date) for r in once.collect()} == want == {(r.validation, r.latest_date) for r in merge_active(once, day).collect()}
    assert merge_active(state.limit(0), day.limit(0)).collect() == [] and len(AKEY) == 5
