import random
import re

import numpy as np
import pyarrow as pa

from netledger.llm import leaks
from netledger.llm.leaks import GAP, MATCH, MISMATCH, align, gram_hashes, leaked_passages, rare_seeds


def words(text):
    clean = re.sub("[​⁠﻿­]", "", text)
    return re.findall(r"[^\W_]+", clean.lower())


def shares(doc, item, n=12):
    grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
    return any(tuple(doc[i : i + n]) in grams for i in range(len(doc) - n + 1))


def test_pairs_match_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(3, 60))) for i in range(12)] + [(20, None), (21, ""), (22, "one two three")]
    docs = []
    for d in range(80):
        body = text(rng.randrange(0, 80))
        if d % 2 and (src := items[rng.randrange(12)][1].split()) and len(src) > 12:
            n = rng.choice([11, 12, 13, len(src)])
            at = rng.randrange(0, len(src) - min(n, len(src)) + 1)
            mess = [w.upper() + rng.choice(["", ",", "*", "_", "​"]) for w in src[at : at + n]]
            body += " … " + rng.choice([" ", "\n", " _ "]).join(mess) + " " + text(9)
        docs.append((d, body))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, items[0][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, pos int")
    got = leaked_passages(df, it, min_share=0.0).where("longest_run >= 12").select("doc_id", "item_id").collect()
    want = {(d, i) for d, a in docs for i, b in items if a and b and shares(words(a), words(b))}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and len(want) > 20


def test_edited_copies_are_scored(spark):
    item = " ".join(f"term{i}" for i in range(40))
    edited = item.replace("term7 ", "other ").replace("term19 ", "").replace("term30 ", "term30 new ")
    docs = spark.createDataFrame([(1, f"intro words {edited} end"), (2, "nothing here at all " * 10)], "doc_id long, text string")
    rows = leaked_passages(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.same_words) for r in rows] == [(1, 5, 38)] and rows[0].longest_run < 12


def test_empty_sides(spark):
    d = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    i = d.withColumnRenamed("doc_id", "item_id")
    assert leaked_passages(d.limit(0), i).collect() == [] and leaked_passages(d, i.limit(0)).collect() == []


def slow_align(a, b):
    best, run = 0, 0
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    r = np.zeros_like(h)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            h[i, j] = max(0, h[i - 1, j - 1] + (MATCH if same else MISMATCH), h[i - 1, j] + GAP, h[i, j - 1] + GAP)
            r[i, j] = r[i - 1, j - 1] + 1 if same else 0
    return int(h.max(initial=0)), int(r.max(initial=0))


def test_alignment_equals_the_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(0, 20)), rng.integers(0, 5, rng.integers(0, 25))
        assert align(a, b)[:2] == slow_align(a, b)


def test_seeds_hit_every_window_that_may_occur():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 8, 9, 40):
        df = rng.integers(0, 12, n)
        seeds = set(rare_seeds(df, 8).tolist())
        windows = [range(i, i + 8) for i in range(n - 7)] or [range(n)]
        assert all(seeds & set(w) for w in windows if n and df[list(w)].min() > 0)
        assert all(df[i] > 0 for i in seeds)


def test_grams_stay_inside_rows():
    flat, sizes = np.arange(12, dtype=np.int64), np.array([4, 0, 5, 3])
    gram, row, pos = gram_hashes(flat, sizes, 3)
    assert list(zip(row.tolist(), pos.tolist())) == [(0, 0), (0, 1), (2, 0), (2, 1), (2, 2), (3, 0)] and len(set(gram.tolist())) == 6


def test_words_are_letters_and_digits_in_any_case():
    mess = ["Zürich_AS64500 «Über» x", "a​b c­d", "", None, "ΟΔΟΣ οδος Οδός", "İzmir i̇zmir", "日本語、テスト。", "_ … -", "n" * 300 + " end"]
    flat, sizes = leaks.WordHasher()(mess)
    fold = lambda t: re.findall(r"[^\W_]+", re.sub("[​­]", "", t or "").replace("İ", "i̇").lower().replace("ς", "σ"))
    want = [fold(t) for t in mess]
    assert sizes.tolist() == list(map(len, want))
    known = {}
    assert all(known.setdefault(w, h) == h for w, h in zip((w for t in want for w in t), flat.tolist()))
    assert len(set(known.values())) == len(known)


def test_long_texts_come_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    item = [f"t{rng.randrange(80)}" for _ in range(50)]
    texts = [[f"t{rng.randrange(80)}" for _ in range(900)] for _ in range(12)]
    for k, t in enumerate(texts):
        t[40 * k : 40 * k] = item[k : k + 9 + k]
        t[700:700] = [w if rng.random() < 0.85 else "other" for w in item]
    bodies = [" ".join(t) for t in texts]
    flat, sizes = leaks.WordHasher()(bodies)
    items = ([7], [leaks.WordHasher()([" ".join(item)])[0]], [30])
    rows = lambda: list(leaks._leaked(iter([pa.record_batch([pa.array(range(12)), pa.array(bodies)], names=["id", "text"])]), *items))
    whole = {tuple(r.values()) for b in rows() for r in b.to_pylist()}
    monkeypatch.setattr(leaks, "PIECE_CHARS", 200)
    monkeypatch.setattr(leaks, "PIECE_WORDS", 60)
    cut_flat, cut_sizes = leaks.WordHasher()(bodies)
    assert (cut_flat == flat).all() and (cut_sizes == sizes).all()
    assert {tuple(r.values()) for b in rows() for r in b.to_pylist()} == whole and len(whole) == 12
