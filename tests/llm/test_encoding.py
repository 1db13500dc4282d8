import random

import pytest

from netledger.llm import encoding as en

SENTENCES = {
    "fr": ["La société a été retirée dès que possible.", "L’équipe réseau génère trop d’alertes.", "Le relevé était lié à un ancien contrat.", "Une annonce répétée reste à vérifier après l’été."],
    "de": ["Die Prüfung wurde am Montag geändert.", "Das ältere Routenobjekt muß gelöscht werden.", "Der Eintrag führt zu längeren Ausfällen.", "Die Übergabe bleibt vorläufig gültig."],
    "ru": ["Запись была удалена ночью.", "Маршрут требует проверки подписи.", "Узел снова работает.", "Компания не подтверждает изменение."],
    "en": ["The contact wrote “please keep it” on Monday.", "It’s the customer’s route, not ours — agreed.", "The café next to the hall lost power at 24 °C.", "Plain text only."],
    "pl": ["Zgłoszenie wymaga źródła.", "Właściciel znów się pojawił.", "Część tablicy działał całą noc.", "Główny łącznik został usunięty później."],
}
LEGIT = ["Σ of Θ and Ω stays below √138 ≈ 26.", "├── as-set\n│   └── Temva", "№ 581 — «Tromtra» ®", "Fish &amp; chips &eacute;", "Kervažon Pivâ", "plain"]


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(1)
    rows = [(lang, " ".join(rng.choices(s, k=4))) for lang, s in SENTENCES.items() for _ in range(150)]
    return rows + [("en", f"{t} {SENTENCES['en'][0]}") for t in LEGIT for _ in range(4)]


@pytest.fixture(scope="module")
def model(sample):
    return en.Model.fit(sample).open()


def sloppy(text, codec):
    """Bytes of UTF-8 read in ``codec``, unassigned bytes as controls."""
    chars = en._byte_chars(codec)
    return "".join(chr(b) if b < 128 else chars[b - 128] for b in text.encode())


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1250", "cp1251", "mac-roman", "cp437", "cp866"])
def test_utf8_read_otherwise_is_restored(model, codec):
    for lang in ("fr", "de", "ru", "pl"):
        for s in SENTENCES[lang]:
            garbled = sloppy(s, codec)
            if garbled != s:
                assert en.restore(f"Plain text only. {garbled}", model)[0] == f"Plain text only. {s}", (codec, s)


def test_twice_and_many_bytes(model):
    s = SENTENCES["fr"][0]
    assert en.restore(sloppy(sloppy(s, "cp1252"), "cp1252"), model)[0] == s
    gbk = "La compañía está en revisión".encode().decode("gb18030", "replace")
    assert en.undo_utf8_multi("n茫o foi", "gb18030") == "não foi" and gbk


@pytest.mark.parametrize("right,wrong,lang", [("cp1251", "koi8-r", "ru"), ("koi8-r", "cp1251", "ru"), ("cp1251", "latin-1", "ru"), ("cp1250", "cp1252", "pl")])
def test_older_encodings(model, right, wrong, lang):
    for s in SENTENCES[lang]:
        garbled = s.encode(right, "ignore").decode(wrong, "replace")
        text, chains, bad = en.restore(garbled, model)
        assert bad and text == s and chains, (garbled, text)


def test_sound_texts_stay(model, sample):
    for text in [t for _, t in sample] + LEGIT + ["", "Spaß“", "CONFIGURAÇÃO À NOITE"]:
        assert en.restore(text, model) == (text, [], False)


def test_lossy_texts_are_reported(model):
    text, chains, bad = en.restore("Le relev� du jour. Plain text only.", model)
    assert bad and chains == [en.LOST] and "�" in text


def test_units_join_to_the_text():
    for t in ["a. b\n\nc", "", "\n", "。あ。い", "x!  y?\r\nz", "no end"]:
        assert "".join(en.split_units(t)) == t


def test_table(spark, sample, monkeypatch):
    rows = [(i, lang, t, 1) for i, (lang, t) in enumerate(sample)]
    bad = [(10_000 + i, lang, sloppy(SENTENCES[lang][i % 4], "cp1252"), 1) for i, lang in enumerate(["fr", "de", "pl", "ru"] * 3)]
    odd = [(20_000, None, None, 1), (20_001, "fr", "", 1), (None, "fr", "Plain", 1), (20_002, "fr", "x" * 200_000 + " é", 1), (20_003, None, "lost �", 1)]
    df = spark.createDataFrame(rows + bad + bad[:1] + odd, "doc_id long, lang string, text string, chains int")
    model = en.fit_model(df)
    got = en.garbled_texts(df, model).collect()
    assert sorted(r.doc_id for r in got) == sorted([r[0] for r in bad + bad[:1]] + [20_003])
    back = {r.doc_id: r.restored_text for r in got}
    assert all(back[i] == SENTENCES[lang][(i - 10_000) % 4] for i, lang, _, _ in bad)
    assert {r.doc_id for r in got if not r.restorable} == {20_003}
    none = en.fit_model(df.limit(0))
    assert [r.doc_id for r in en.garbled_texts(df, none).collect()] == [20_003] and en.garbled_texts(df.limit(0), none).collect() == []


def test_parts_of_a_sentence(model):
    s = SENTENCES["ru"][1]
    first, rest = s.split(" ", 1)
    garbled = first + " " + rest.encode("koi8-r").decode("cp1251")
    assert en.restore(garbled, model)[0] == s
    mixed = "Die Prüfung durch Tre▀npu wurde am Montag geändert."
    assert en.restore(mixed, model)[0] == mixed.replace("▀", "ß")
    assert en.mixed("T╓npu") and en.mixed("Rφrna") and en.mixed("Timt├»") and not any(map(en.mixed, ["├── as-set", "Σ of Θ", "naïve’s", "word—word", "№ 5", "346 µs", "完了 ok", "a​b"]))


def test_the_code_tells_all_characters_apart():
    seen = [chr(0x4E00 + i) for i in range(13_000)]
    code = en.code_of(seen)
    assert len(set(code.values())) == len(seen) and {len(c) for c in code.values()} == {2, 3}
    assert all(c[0] < 192 if len(c) == 2 else 192 <= c[0] < 255 for c in code.values())


def test_small_languages_share_a_group(spark, sample):
    rows = [(i, "en" if lang == "en" else f"{lang}{i % 40}", t) for i, (lang, t) in enumerate(sample)]
    model = en.fit_model(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert set(model.pairs) == {"en", en.REST} and en.restore(sloppy(SENTENCES["fr"][0], "cp1252"), model.open())[0] == SENTENCES["fr"][0]


def test_stretches_part_at_wide_characters(model):
    unit = "ºòÌë¤Î ¤Ë¹¹¿· 移転の申請は ¤Î"
    assert [unit[a:b] for a, b in en._odd_parts(unit, model)] == ["ºòÌë¤Î ¤Ë¹¹¿·", "移転の申請は", "¤Î"]
    assert en._odd_parts("ºòÌë¤Î ¤Ë", model) == [] and en._odd_parts("", model) == []
