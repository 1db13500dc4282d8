import random

from netledger.operators import intervals as iv


def brute(rows):
    """Periods and gaps of each entity, point by point."""
    periods, gaps = set(), set()
    for e in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((lo, hi) for x, lo, hi in rows if x == e and lo is not None and hi is not None and lo < hi)
        merged = []
        for lo, hi in spans:
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        periods |= {(e, lo, hi) for lo, hi in merged}
        gaps |= {(e, a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return periods, gaps


def run(spark, rows, hot_rows):
    df = spark.createDataFrame(rows, "e string, lo long, hi long").withColumnRenamed("e", "slice").repartition(3)
    lists, cut_up = iv.disjoint_spans(df, "slice", "lo", "hi", hot_rows=hot_rows)
    return {tuple(r) for r in iv.periods(lists, cut_up).collect()}, {tuple(r) for r in iv.gaps(lists, cut_up).collect()}, cut_up


def test_spans_match_brute_force_sliced_or_not(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), lo := rng.randrange(2000), lo + rng.choice([-3, 0, 1, 5, 5, 40])) for _ in range(900)]
    rows += [("a", 100, 1900), ("d", 5, 6), ("d", 6, 9), ("d", 5, 6), ("a", None, 3), ("a", 3, None)]
    want = brute(rows)
    for hot in (10**6, 40, 7):
        got = run(spark, rows, hot)
        assert got[:2] == want
    assert run(spark, rows, 7)[2]


def test_spans_empty_table(spark):
    assert run(spark, [], 10) == (set(), set(), False)


def test_long_span_covers_later_slices(spark):
    rows = [("a", i * 10, i * 10 + 1) for i in range(50)] + [("a", 0, 495)]
    assert run(spark, rows, 5)[:2] == brute(rows)


def test_offsets(spark):
    rows = [(1, [3, 1, 1, 5, 9]), (1, [4]), (2, []), (3, None), (4, [None, -1, 365, 400]), (5, [0, 364]), (None, [1])]
    lists = iv.disjoint_offsets(spark.createDataFrame(rows, "id long, days array<int>"), "id", "days", 0, 364)
    assert {tuple(r) for r in iv.gaps(lists).collect()} == {("1", 2, 3), ("1", 6, 9), ("5", 1, 364)}
    assert {tuple(r) for r in iv.periods(lists).collect()} == {("1", 1, 2), ("1", 3, 6), ("1", 9, 10), ("5", 0, 1), ("5", 364, 365)}


def test_orders_agree_whatever_the_range():
    import numpy as np

    from netledger.operators.intervals import _merge_order

    rng = np.random.default_rng(4)
    for big in (50, 2**61):
        group, lo = rng.integers(0, 9, 400) * 2, rng.integers(-big, big, 400)
        assert (_merge_order(group, lo) == np.lexsort((lo, group))).all()
