import random

from netledger.llm import encoding as en
from tests.llm.test_encoding import SENTENCES, sloppy


def table(spark, more=(), long=3):
    rng = random.Random(4)
    rows = [(lang, " ".join(rng.choices(s, k=4)), f"s{i % 3}") for lang, s in SENTENCES.items() for i in range(60)]
    rows += [("fr", "Le cœur du réseau est prêt. " * 4_000, None)] * long + [(None, "Über Öl. " + SENTENCES["de"][i % 4], "s0") for i in range(50)] + list(more)
    return rows, spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string, source string")


def test_all_texts_count(spark):
    """Long texts and those without a language too; counts are those of a fit in one place."""
    rows, df = table(spark)
    got = en.fit_model(df)
    want = en.Model.fit([(r[0] or en.REST, r[1]) for r in rows], sources=[r[2] for r in rows])
    assert got.home == want.home and got.pairs == want.pairs and got.code == want.code
    assert "œ" in got.home["fr"] and "Ö" in got.home[en.REST] and set(got.dictionaries) == set(want.dictionaries)


def test_merged_dictionaries_restore(spark, monkeypatch):
    for name, value in (("SHARD_CHARS", 4_000), ("MERGED", 2), ("HELD", 50)):
        monkeypatch.setattr(en, name, value)
    garbled = sloppy(SENTENCES["fr"][0], "cp1252")
    rows, df = table(spark, [("fr", garbled, "s1"), ("pl", sloppy(SENTENCES["pl"][2], "cp1250"), "s2")], long=0)
    one, other = en.fit_model(df.repartition(1)), en.fit_model(df.repartition(7))
    assert one.__reduce__() == other.__reduce__() and set(one.dictionaries) >= set(SENTENCES)
    got = {r.doc_id: r.restored_text for r in en.garbled_texts(df, one).collect()}
    assert got == {len(rows) - 2: SENTENCES["fr"][0], len(rows) - 1: SENTENCES["pl"][2]}
