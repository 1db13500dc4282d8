import itertools
import random

import pytest

from netledger.llm.names import Words, _tokenized, candidate_pairs, components, edits, grams, learn_words, link_names, parse, soft_similarity, spelling_pairs, tokens

TRADES = {"Fibre": "Fbr", "Hosting": "Hstg", "Communications": "Comms", "Systems": "Sys", "University": "Uni", "Telecom": "Tlcm", "Internet Exchange": "IX"}
LEGALS = {"Pty Ltd": "Pty Limited", "AB": "A.B.", "Inc.": "Incorporated"}


def crowd(n=400):
    """Names of other organisations, from which words are learnt: some in full, some with short forms beside."""
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(k)).title()
    out = []
    for i in range(n):
        first, second, trade, legal = word(4), word(3), rng.choice(list(TRADES)), rng.choice(list(LEGALS))
        out.append(f"{first} {second} {trade} {legal}")
        if i % 4 == 0:
            out.append(f"{first} {second} {TRADES[trade]} {legal}")
        if i % 5 == 0:
            out.append(f"{first} {second} {trade} {LEGALS[legal]}")
        if i % 40 == 7:
            out.append(f"Ms {first} {second} {trade} {legal}")
    return out


CROWD = crowd()


@pytest.fixture(scope="module")
def words(spark):
    names = spark.createDataFrame([(n,) for n in CROWD], "name string")
    return learn_words(names.mapInArrow(_tokenized, "toks array<string>"), len(CROWD))


def test_words_are_learnt(words):
    m = words.meanings
    assert m["fbr"] == ("fibre",) and m["comms"] == ("communications",) and m["ix"] == ("exchange", "internet") and m["limited"] == ("ltd",)
    assert m["ms"] == () and all(m[w] == (w,) for w in ("fibre", "hosting", "ltd", "pty", "inc"))
    assert ("fibre", "hosting") in words.rivals and ("pty", "ltd") not in words.rivals and ("internet", "exchange") not in words.rivals and ("fibre", "ltd") not in words.rivals
    assert words.weight("neverseen") > words.weight("fibre") > 0
    assert words.compatible(["fibre", "ltd"], ["fibre", "ltd", "pty"]) and words.compatible([], ["inc"]) and not words.compatible(["fibre"], ["hosting"])


def test_no_words_are_learnt_from_few_names(spark):
    empty = spark.createDataFrame([], "toks array<string>")
    assert learn_words(empty, 1).meanings == {} and Words().weight("x") > 0


def test_tokens_fold_marks_and_case():
    assert tokens("  M/s Tömako-Pindo G.m.b.H. ") == ["ms", "tomako", "pindo", "gmbh"]
    assert tokens("AS-TONPINDO") == ["tonpindo"] and tokens("TON-PINDO-AS") == ["ton", "pindo"]
    assert tokens("TonPindo") == ["ton", "pindo"] and tokens("") == [] and tokens("—") == []


def test_parse_separates_generic_words(words):
    assert parse("Pindo, Tonkefo Fbr Ltd.", words) == (["pindo", "tonkefo"], ["fibre", "ltd"])
    assert parse("Tonkefo Pindo Internet Exch A/B", words) == (["pindo", "tonkefo"], ["ab", "exchange", "internet"])
    assert parse("Ms Tonkefo Pindo Host Ing", words) == (["pindo", "tonkefo"], ["hosting"])
    assert parse("", words) == ([], []) and parse("Fibre", words)[1] == ["fibre"]


def test_edits_counts_swaps_once():
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "abc", 0) == 0 and edits("abc", "xyz", 1) == 2 and edits("ab", "abcd", 1) == 2


def test_similarity():
    sim = lambda a, b: soft_similarity(sorted(a.split()), sorted(b.split()))
    assert sim("tonkefo pindo", "pindo tonkefo") == 1
    assert sim("tonkefo pindo", "tonkeof pindo") >= 0.85 and sim("tonkefo pindo", "tonkefopindo") >= 0.85
    assert 0.5 <= sim("ton pindo", "tonkefo pindo") < 0.85 and 0.5 <= sim("tonpindo", "tonkefo pindo") < 0.85
    assert sim("tonkefo milpo", "tonkefo pindo") == 0 and sim("tonkefo pindo", "harbuna pindo") == 0 and sim("ton pi", "tonkefo pindo") == 0


def test_rare_tokens_count_more():
    common = lambda t: 1.0 if t in ("berlin", "norte") else 8.0
    sim = lambda a, b: soft_similarity(sorted(a.split()), sorted(b.split()), common)
    assert sim("tonkefo pindo berlin", "tonkefo pindo") >= 0.85 > sim("tonkefo pindo harbuna", "tonkefo pindo")
    assert sim("tonkefo berlin norte", "harbuna berlin norte") == 0


def test_candidates_are_all_similar_sets(spark):
    rows = [(i, grams([w.lower() for w in n.split()[:2]])) for i, n in enumerate(CROWD[:250] + [n[:3] + n[4:] for n in CROWD[:60]])]
    df = spark.createDataFrame(rows, "node long, grams array<string>")
    count = {}
    for _, g in rows:
        for x in g:
            count[x] = count.get(x, 0) + 1
    import math

    w = {x: math.log1p(len(rows) / k) for x, k in count.items()}
    total = lambda g: sum(w[x] for x in g)
    want = {(i, j) for i, a in rows for j, b in rows if i < j and sum(w[x] for x in set(a) & set(b)) >= 0.35 * min(total(a), total(b))}
    got = [tuple(sorted(r)) for r in candidate_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want) > 60


def test_long_chains_are_one_component(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    nodes = spark.range(n + 3)
    comp = {r.id: r.comp for r in components(nodes, links).collect()}
    assert {comp[i] for i in range(n + 1)} == {0} and comp[n + 1] == n + 1 and comp[n + 2] == n + 2


GROUPS = [
    ["Tonkefo Pindo Fibre Pty Ltd", "TONKEFO PINDO FIBRE PTY LTD", "Tonkefo Pindo Fbr Pty Limited", "Pindo, Tonkefo Fibre", "Tönkefo Pindo Fibre Pty Ltd", "Tonkeof Pindo Fibre Pty Ltd", "AS-TONPINDO", "Ton. Pindo Fibre Pty Ltd"],
    ["Tonkefo Milpo Hosting AB", "tonkefo milpo hosting ab", "TONKEFO-MILPO-AS"],
    ["Hulgamis Milpo Communications", "HulMilpo", "Hulgamis Milpo Comms."],
    ["Drolgidus Ganfo Systems Inc.", " Drolgidus  Ganfo Systems Inc"],
    ["Alone Only University"],
]


def test_links_are_the_groups(spark):
    rows = [(n, "x") for g in GROUPS for n in g] * 2 + [(None, "x"), ("", "x"), ("—", "x")] + [(n, "x") for n in CROWD]
    df = spark.createDataFrame(rows, "name string, org string")
    linked = link_names(df)
    ours = {n for g in GROUPS for n in g}
    got = {tuple(r) for r in spelling_pairs(linked).collect() if ours & set(r)}
    want = {tuple(sorted(p)) for g in GROUPS for p in itertools.combinations(g, 2)}
    assert got == want
    assert linked.count() == len({r[0] for r in rows if r[0] is not None})


def test_ambiguous_short_form_ties_nothing_together(spark):
    names = ["Kasbutrom Geha Telecom AB", "Kasvudel Geha Telecom AB", "Kas Geha Telecom AB"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert spelling_pairs(link_names(df)).collect() == []


def test_no_names(spark):
    assert link_names(spark.createDataFrame([], "name string")).collect() == []
