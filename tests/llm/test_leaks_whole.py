import random

import numpy as np

from netledger.llm.leaks import align_many, best_scores, leaked_passages, shared_runs
from tests.llm.test_leaks import shares, words


def test_every_pair_that_scores_is_found(spark):
    """Whatever it shares: runs of any length, grams that are common in the corpus, no gram at all."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [[rng.choice(vocab) for _ in range(rng.randrange(8, 70))] for _ in range(10)]
    docs = []
    for d in range(120):
        copy = [w if rng.random() < 0.8 else rng.choice(vocab) for w in rng.choice(items) if rng.random() < 0.9]
        other = [w for x in rng.choice(items)[:30] for w in (x, f"x{d}")]
        docs.append([rng.choice(vocab) for _ in range(rng.randrange(40))] + rng.choice([copy, other, []]) + [rng.choice(vocab) for _ in range(rng.randrange(90))])
    ids = {w: i for i, w in enumerate(sorted({w for t in items + docs for w in t}))}
    pairs = [(np.array([ids[w] for w in i]), np.array([ids[w] for w in d], dtype=np.int64)) for d in docs for i in items]
    exact = align_many(pairs)
    assert best_scores(pairs).tolist() == [x[0] for x in exact]
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], f"{key} long, text string")
    keys = [(d, i) for d in range(len(docs)) for i in range(len(items))]
    for least in (24, 30, 130):
        got = leaked_passages(frame(docs, "doc_id"), frame(items, "item_id"), min_score=least, min_share=0.0).collect()
        want = {(*k, *x) for k, x in zip(keys, exact) if x[0] >= least}
        assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
        assert least > 30 or sum(r[3] < 5 for r in want) > 3


def test_common_grams_are_no_obstacle(spark):
    a, b = " ".join(f"a{i}" for i in range(9)), " ".join(f"b{i}" for i in range(9))
    docs = spark.createDataFrame([(i, f"{a} between {i} {b}") for i in range(60)], "doc_id long, text string")
    item = spark.createDataFrame([(1, f"{a} quite other {b}")], "item_id long, text string")
    assert {(r.doc_id, r.score) for r in leaked_passages(docs, item, min_share=0.0).collect()} == {(i, 34) for i in range(60)}
    assert shared_runs(docs, item).collect() == []


def test_shared_runs_are_the_long_runs(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"t{rng.randrange(50)}" for _ in range(40))) for i in range(5)]
    docs = [(d, " ".join(f"t{rng.randrange(50)}" for _ in range(20)) + " " + " ".join(items[d % 5][1].split()[d % 7 : d % 7 + 10 + d % 4])) for d in range(60)]
    got = shared_runs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i) for d, a in docs for i, b in items if shares(words(a), words(b))}
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 20


def test_edited_copies_are_told_from_texts_of_one_template(spark):
    """Recall and precision on planted copies among texts that share the items' templates."""
    rng = random.Random(6)
    name = lambda: "n" + "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    frames = [[f"f{t}w{i}" for i in range(rng.randrange(9, 14))] for t in range(12)]
    sentence = lambda: [w for x in rng.choice(frames) for w in ([x, name()] if rng.random() < 0.3 else [x])]
    items = [[w for _ in range(4) for w in sentence()] for _ in range(30)]
    docs, planted = [], set()
    for d in range(400):
        body = [w for _ in range(rng.randrange(2, 12)) for w in sentence()]
        if d % 4 == 0:
            k = rng.randrange(30)
            copy = [w if rng.random() < 0.93 else name() for w in items[k] if rng.random() < 0.95]
            at = rng.randrange(len(body))
            body[at:at] = copy
            planted.add((d, k))
        docs.append((d, " ".join(body)))
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), frame).collect()}
    assert len(got & planted) >= 0.97 * len(planted) and len(got & planted) >= 0.97 * len(got)
