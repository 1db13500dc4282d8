import random

import pytest

from netledger.llm import encoding as en
from tests.llm.test_encoding import SENTENCES


@pytest.mark.parametrize("right,wrong,lang", [("koi8-r", "cp1251", "ru"), ("cp1250", "cp1252", "pl")])
def test_a_source_garbled_throughout_is_found(spark, right, wrong, lang):
    rng = random.Random(6)
    rows = [(lg, " ".join(rng.choices(s, k=4)), f"s{i % 5}") for lg, s in SENTENCES.items() for i in range(150)]
    sound = [" ".join(rng.choices(SENTENCES[lang], k=3)) for _ in range(40)]
    bad = [(lang, t.encode(right, "ignore").decode(wrong), "odd") for t in sound]
    table = [(i, *r) for i, r in enumerate(rows + bad)]
    df = spark.createDataFrame(table, "doc_id long, lang string, text string, source string")
    got = {r.doc_id: r.restored_text for r in en.garbled_texts(df, en.fit_model(df)).collect()}
    assert got == {len(rows) + i: t for i, t in enumerate(sound)}


def test_other_rows_too_few_to_tell():
    rows = [("ru", " ".join(SENTENCES["ru"]))] * 100
    alone, all_rows = en.Model.fit(rows, sources=["a"] * 95 + ["b"] * 5), en.Model.fit(rows)
    assert alone.pairs == all_rows.pairs and all_rows.pairs["ru"]
