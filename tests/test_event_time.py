import random

import numpy as np
from pyspark.sql import functions as F

from netledger.operators import event_time as et


def test_last_known_is_the_latest_row_known_in_time():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 40)
        known = np.array([rng.randrange(30) for _ in range(n)])
        start = np.array([rng.randrange(0, n + 1) for _ in range(20)])
        stop = np.array([rng.randrange(s, n + 1) for s in start])
        limit = np.array([rng.randrange(-2, 32) for _ in range(20)])
        want = [max((i for i in range(a, b) if known[i] <= m), default=-1) for a, b, m in zip(start, stop, limit)]
        assert et.last_known(known, start, stop, limit).tolist() == want


def test_attributes_as_of_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    versions = [(rng.choice("xyz"), rng.randrange(20), rng.randrange(20), rng.choice([None, 1, 2])) for _ in range(120)]
    versions = list({(k, v, n): (k, v, n, x) for k, v, n, x in versions}.values()) + [("x", None, 1, 1), (None, 1, 1, 1)]
    events = [(i, rng.choice(["x", "x", "y", "z", "w", None]), rng.randrange(-1, 22), rng.choice([None, *range(22)])) for i in range(300)]
    h = spark.createDataFrame(versions, "uri string, since long, known long, color long")
    hist = {"color": et.change_history(h, "uri", F.col("since"), F.col("known"), "color", "color")}
    ev = spark.createDataFrame(events, "value long, kind string, at long, seen long")  # names that clash with the operator's own
    for most, chunk in ((40, 200_000), (10**6, 50)):
        monkeypatch.setattr(et, "CHUNK_ROWS", chunk)
        got = et.attributes_as_of(ev, hist, key="kind", valid_us="at", known_us="seen", payload=["value", "kind"], types={"color": "long"}, hot_events=most)
        rows = {r["value"]: (r["color"], r["color_found"]) for r in got.collect()}
        assert len(rows) == len(events)
        for i, k, at, seen in events:
            seen_rows = [(v, n, c) for key, v, n, c in versions if key == k and k is not None and v is not None and seen is not None and v <= at and n <= seen]
            best = max(seen_rows, key=lambda r: r[:2]) if seen_rows else None
            assert rows[i] == ((best[2], True) if best else (None, False)), (i, k, at, seen)


def test_empty_sides(spark):
    h = spark.createDataFrame([], "uri string, since long, known long, color long")
    hist = {"color": et.change_history(h, "uri", F.col("since"), F.col("known"), "color", "color")}
    ev = spark.createDataFrame([(1, "x", 1, 1)], "id long, k string, at long, seen long")
    one = lambda e: et.attributes_as_of(e, hist, key="k", valid_us="at", known_us="seen", payload=["id"], types={"color": "long"}).collect()
    assert [tuple(r) for r in one(ev)] == [(1, None, False)]
    assert one(ev.limit(0)) == []
