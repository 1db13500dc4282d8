import random
from collections import Counter

from netledger.operators.skew import heavy_hitters, heavy_keys, per_key_profile
from netledger.operators.snapshot_diff import snapshot_changes


def test_profile_of_skewed_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["b", "c", None, f"k{rng.randrange(50)}"]), rng.choice([None, *range(30)]), rng.randrange(4)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "v string, m long, __salt long")
    got = {r["v"]: (r["n"], r["d"], r["e"]) for r in per_key_profile(df, "v", distinct={"d": "m", "e": "__salt"}, share=0.1, salts=3, count_name="n").collect()}
    want = {}
    for k in {r[0] for r in rows} - {None}:
        mine = [r for r in rows if r[0] == k]
        want[k] = (len(mine), len({r[1] for r in mine} - {None}), len({r[2] for r in mine}))
    assert got == want
    assert per_key_profile(df.limit(0), "v", distinct={"d": "m"}).collect() == []


def test_heavy_keys_count_null_rows_in_the_total(spark):
    rows = [("a",)] * 30 + [("b",)] * 10 + [(None,)] * 60
    df = spark.createDataFrame(rows, "k string")
    assert {tuple(r) for r in heavy_keys(df, "k", 0.3).collect()} == {("a", 30)}
    assert {tuple(r) for r in heavy_keys(df, "k", 0.1).collect()} == {("a", 30), ("b", 10)}
    assert "a" in {r.k for r in heavy_hitters(df, "k", share=0.2).collect()}


def brute_changes(rows):
    snaps = {}
    for s, d, k, v, _ in rows:
        if s is not None and d is not None:
            snaps.setdefault(s, {}).setdefault(d, {})[k] = v
    out = set()
    for s, by in snaps.items():
        days = sorted(by)
        for a, b in zip(days, days[1:]):
            old, new = by[a], by[b]
            out |= {(b, s, k, "added") for k in new.keys() - old.keys()} | {(b, s, k, "removed") for k in old.keys() - new.keys()}
            out |= {(b, s, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    return out


def test_changes_match_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for s in ("big", "small", None):
        for d in range(1, 6):
            if s == "small" and d == 3:
                continue
            for k in rng.sample([None, *range(25)], 20 if s == "big" else 4):
                rows.append((s, d, k, rng.choice(["x", "x", "y", "", None]), 0))
    rows.append(("big", None, 1, "x", 0))
    late = [r[:4] + (9,) for r in rng.sample(rows, 10)]  # delivered twice
    df = spark.createDataFrame(rows + late, "src string, ord long, k1 long, val string, __snap long")
    got = snapshot_changes(df, source="src", snapshot="ord", key=["src", "k1"], values=["val"], latest="__snap").collect()
    assert len(got) == len(set(got))
    assert {(r["ord"], r["src"], r["k1"], r["change_kind"]) for r in got} == brute_changes(rows)
    assert snapshot_changes(df.limit(0), source="src", snapshot="ord", key=["src", "k1"], values=["val"]).collect() == []


def test_latest_of_conflicting_rows_stands(spark):
    rows = [("s", 1, 7, "a", 1), ("s", 2, 7, "b", 1), ("s", 2, 7, "a", 2)]
    df = spark.createDataFrame(rows, "s string, d long, k long, v string, t long")
    assert snapshot_changes(df, source="s", snapshot="d", key=["s", "k"], values=["v"], latest="t").collect() == []
    assert Counter(r.change_kind for r in snapshot_changes(df.where("t = 1"), source="s", snapshot="d", key=["s", "k"], values=["v"], latest="t").collect()) == {"changed": 1}
