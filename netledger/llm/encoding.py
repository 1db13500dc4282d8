"""Texts garbled by a wrong character encoding: found, and restored where the bytes survive.

The unit of decision is a sentence or line. For each unit every chain of wrong decodings that could
have produced it is undone, and each candidate is compressed with zstandard under a dictionary of
each language, trained on texts that show no trace of garbling. The chain with the least
description length, its own cost included, wins; the unit itself is the candidate without a chain,
so a text that no chain shortens is left unchanged. What stays unusual in a unit is tried word by word,
for a part of a sentence may be garbled alone.

Units whose pairs of neighbouring characters are all usual in one language, whichever source is left
out, need no candidates. Two
kinds of chain exist. Chains that read UTF-8 bytes in another encoding leave byte sequences of a
fixed form. Chains between two older encodings leave no form, cost more, and must remove most of
the unusual pairs; they cost less where a word mixes scripts or holds a sign between letters, which is a
form too, and in the other units of a document that shows one.

Before compression a text is written in a code of its own: ASCII as it is, other characters seen in
the languages in two or three bytes, characters never seen in five. UTF-8 lengths would favour short
scripts, whatever the text says.

The replacement character is a class of its own: what it stands for is lost, so no chain can undo it. Such a
document is reported with the chain ``LOST``, its text restored as far as other units allow.

The model is fitted on all texts of the table: characters and pairs are counted in the scan, dictionaries are
trained on shards of ``SHARD_CHARS`` characters and trained again on each other's content until one a language is left.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netledger.session import cut

#: Characters of a language from which one task trains a dictionary, about; dictionaries that one task merges; bytes of
#: their content that count as one text then; counts a task holds before it passes them on.
SHARD_CHARS, MERGED, PIECE, HELD = 4_000_000, 16, 1024, 500_000
#: Languages with fewer texts than LEAST, and all but the OWN most frequent, share one dictionary.
LEAST, OWN, REST = 40, 30, "\0rest"
DICTIONARY_BYTES = 64 * 1024
#: Share of a language's documents a character must occur in to be at home there.
AT_HOME, SEEN = 0.01, 0.0008
#: Share of a language's documents a pair of neighbours must occur in to raise no question:
#: in the first fit, whose texts still hold garbled ones, and in the second.
USUAL_FIRST, USUAL_PAIR = 0.025, 0.004
#: Costs in bytes: of a chain by kind, of one that makes a mixed word whole, of each further layer, and what a
#: chain must save.
COST_UTF8, COST_LEGACY, COST_MIXED, COST_LAYER, MARGIN = 1.0, 5.0, 0.0, 1.5, 0.5
#: Chain of texts with the replacement character.
LOST = "lost"

# fixed values: encodings in which UTF-8 bytes get read, one byte a character
SINGLE = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "mac-roman", "cp437", "cp850", "cp866", "koi8-r", "iso8859-15", "cp1254", "cp1253", "iso8859-5", "iso8859-9", "cp852", "mac-cyrillic")
# fixed values: encodings of several bytes a character in which UTF-8 bytes get read
MULTI = ("gb18030", "cp932", "big5", "cp949", "euc-jp")
# fixed values: older encodings of texts, and those in which they get read
LEGACY_RIGHT = ("cp1252", "cp1250", "cp1251", "iso8859-2", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "iso8859-5", "cp852")
LEGACY_WRONG = ("latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac-roman", "koi8-r", "iso8859-2", "cp852")
LEGACY_MULTI = ("cp932", "gb18030", "euc-jp", "cp949")

_UNIT = re.compile(r"(\r\n|\n|\r|(?<=[.!?。．！？])[ 　]+|(?<=[。！？]))")
_HIGH = re.compile(r"[^\x00-\x7f]")
_HIGH_RUN = re.compile(r"[^\x00-\x7f]{2}")
_WIDE = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\uff00-\uffef\ue000-\uf8ff\u3000-\u30ff]")
_DIGITS = frozenset("123456789")
_ZERO = {ord(d): "0" for d in _DIGITS}
_DRAWN = re.compile("[\u2500-\u259f][^\\W\\d_]|[^\\W\\d_][\u2500-\u259f]")
_WORD = re.compile(r"(?:[^\s\x21-\x7e]|[A-Za-z])+")
_CONTROL = re.compile("[\x80-\x9f]")
_HIGHS = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=None)
def _byte_chars(codec: str) -> tuple[str | None, ...]:
    """Characters of bytes 128..255; bytes a Windows code page leaves out stand for themselves."""
    out = []
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        out.append(ch)
    return tuple(out)


@lru_cache(maxsize=None)
def _byte_set(codec: str) -> frozenset[str]:
    return frozenset(_byte_chars(codec))


@lru_cache(maxsize=None)
def _utf8_form(codec: str) -> tuple[re.Pattern, dict[str, int]]:
    """Pattern of runs made of UTF-8 sequences alone, as they look in ``codec``, and the byte of each character.

    A run must be such sequences from end to end: in scripts whose letters all are lead or tail
    bytes, parts of ordinary words would match.
    """
    chars = _byte_chars(codec)
    group = lambda lo, hi: "[" + "".join(re.escape(chars[b - 128]) for b in range(lo, hi + 1)) + "]"
    tail = group(0x80, 0xBF)
    form = f"(?:{group(0xC2, 0xDF)}{tail}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xF0, 0xF4)}{tail}{{3}})"
    return re.compile(f"(?<![^\\x00-\\x7f]){form}+(?![^\\x00-\\x7f])"), {ch: b for b, ch in enumerate(chars, 128)}


def undo_utf8(text: str, codec: str) -> str | None:
    """``text`` with every run of UTF-8 sequences that was read in ``codec`` decoded; None if there is none."""
    form, byte = _utf8_form(codec)
    changed = False

    def right(m: re.Match) -> str:
        nonlocal changed
        try:
            out = bytes(byte[ch] for ch in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        changed = True
        return out

    out = form.sub(right, text)
    return out if changed else None


_MULTI_RUN = re.compile(r"[^\x00-\x7f]+[\x21-\x7e]?")


def undo_utf8_multi(text: str, codec: str) -> str | None:
    """The same for encodings of several bytes; a run may have swallowed the ASCII byte behind it."""
    changed = False

    def right(m: re.Match) -> str:
        nonlocal changed
        for run, rest in ((m[0], ""), (m[0][:-1], m[0][-1:])):
            try:
                out = run.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            if out != run and out:
                changed = True
                return out + rest
        return m[0]

    out = _MULTI_RUN.sub(right, text)
    return out if changed else None


@lru_cache(maxsize=None)
def _legacy_map(wrong: str, right: str) -> dict[int, str]:
    return {ord(w): r for w, r in zip(_byte_chars(wrong), _byte_chars(right)) if w != r and ord(w) > 127}


def undo_legacy(text: str, wrong: str, right: str) -> str | None:
    out = text.translate(_legacy_map(wrong, right))
    return out if out != text else None


def undo_legacy_multi(text: str, wrong: str, right: str) -> str | None:
    """Text of an older encoding of several bytes that was read one byte a character."""
    if not _byte_set(wrong).issuperset(_HIGH.findall(text)):
        return None
    try:
        out = text.translate(_as_bytes(wrong)).encode("latin-1").decode(right)
    except UnicodeDecodeError:
        return None
    return out if out != text else None


@lru_cache(maxsize=None)
def _as_bytes(wrong: str) -> dict[int, int]:
    return {ord(ch): b for b, ch in enumerate(_byte_chars(wrong), 128)}


def split_units(text: str) -> list[str]:
    """Sentences and lines with the separators between them; joining gives the text."""
    return [x for x in _UNIT.split(text) if x]


def structural(unit: str, seen: set[str]) -> bool:
    """Does the unit hold a trace: a replacement character, a control of 128..159, or runs that are
    UTF-8 of characters seen elsewhere, read in another encoding?"""
    if "�" in unit or _CONTROL.search(unit):
        return True
    if not _HIGH_RUN.search(unit):
        return False
    for codec in ("cp1252", "latin-1", "mac-roman", "cp437", "cp1250", "cp1251", "cp866"):
        out = undo_utf8(unit, codec)
        if out is not None and seen.issuperset(ch for ch in out if ch > "\x7f"):
            return True
    return False


def high_pairs(text: str) -> set[str]:
    """Neighbouring characters of which one isn't ASCII; digits count alike."""
    found = set()
    for m in _HIGHS.finditer(text):
        run = text[max(0, m.start() - 1) : m.end() + 1]
        found.update(map("".join, zip(run, run[1:])))
    return {p if p[0] not in _DIGITS and p[1] not in _DIGITS else p.translate(_ZERO) for p in found}


@lru_cache(maxsize=65536)
def _script(ch: str) -> str:
    """Script of a letter by its name, ``sign`` of symbols and the middle dot, nothing of other punctuation."""
    return unicodedata.name(ch, "sign").split()[0] if ch.isalpha() else "sign" if unicodedata.category(ch)[0] in "SC" or ch == "·" else ""


def mixed(text: str) -> bool:
    """Does a word mix alphabets, hold a sign beyond ASCII between letters, or a drawing sign beside one?"""
    kinds = {_script(ch) for ch in set(_HIGH.findall(text))}
    if kinds <= {"LATIN", ""} or kinds.isdisjoint(("LATIN", "CYRILLIC", "GREEK", "sign")):
        return False
    for word in _WORD.findall(text):
        if word.isascii() or len(word) < 2:
            continue
        if _DRAWN.search(word):
            return True
        scripts = [_script(ch) for ch in word if ch != "´" and unicodedata.category(ch) != "Cf"]
        at = [i for i, x in enumerate(scripts) if x in ("LATIN", "CYRILLIC", "GREEK")]
        if at and (len({scripts[i] for i in at}) > 1 or "sign" in scripts[at[0] : at[-1]]):
            return True
    return False


class Model:
    """What the clean texts teach: dictionaries, characters seen and characters at home."""

    def __init__(self, code: dict[str, bytes], home: dict[str, frozenset[str]], pairs: dict[str, frozenset[str]], dictionaries: dict[str, bytes]):
        self.code, self.home, self.pairs, self.dictionaries = code, home, pairs, dictionaries
        self._exchanges: dict[frozenset[str], list[tuple[str, str]]] = {}
        self._languages: dict[str, int] = {}  # pair to the languages it is usual in, one bit each
        for i, usual in enumerate(pairs.values()):
            for p in usual:
                self._languages[p] = self._languages.get(p, 0) | 1 << i

    @classmethod
    def fit(cls, sample: list[tuple[str, str]], usual: float = USUAL_PAIR, strict: bool = False, sources: list[str | None] | None = None) -> Model:
        """From rows (language, text); garbled-looking units are left out of the dictionaries.

        ``sources`` tells where each row comes from: a pair must be usual without any one of them, as
        one that was decoded wrongly throughout repeats its garbled pairs. Where fewer than ``LEAST``
        rows of the language come from elsewhere, they can't say what is usual, and all rows count.

        ``strict`` also leaves out units with unusual pairs, lest garbled forms teach a dictionary.
        """
        rows: dict[str, list[tuple[str, str | None]]] = {}
        for (lang, text), source in zip(sample, sources or [None] * len(sample)):
            rows.setdefault(lang, []).append((text, source))
        return fit_in_steps(lambda step: {lang: step(lang, r) for lang, r in rows.items()}, usual, strict)

    def encode(self, text: str) -> bytes:
        if text.isascii():
            return text.encode()
        code = self.code
        return b"".join(ch.encode() if ch < "\x80" else code.get(ch) or b"\xff" + ord(ch).to_bytes(4, "big") for ch in text)

    def open(self) -> Model:
        """Make compressors; once a worker."""
        import zstandard

        params = zstandard.ZstdCompressionParameters.from_level(12, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
        self.compressors = {}
        for lang, raw in self.dictionaries.items():
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=12)
            self.compressors[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        return self

    def __reduce__(self):
        return Model, (self.code, self.home, self.pairs, self.dictionaries)

    def length(self, text: str, languages=None) -> tuple[float, str]:
        """Least compressed length over the languages, and the language."""
        raw = self.encode(text)
        best, lang = math.inf, ""
        for name in languages or self.compressors:
            size = len(self.compressors[name].compress(raw))
            if size < best:
                best, lang = size, name
        return (best, lang) if lang else (float(len(raw)), "")

    def at_home(self, text: str) -> list[str]:
        """Languages at home with every character of the text."""
        high = set(_HIGH.findall(text))
        return [lang for lang, chars in self.home.items() if high <= chars]


    def unusual(self, text: str) -> int:
        """Pairs of neighbours, not both ASCII, unknown to the language that knows most of them."""
        found = high_pairs(text)
        all_know = -1
        for p in found:
            all_know &= self._languages.get(p, 0)
        if all_know and self.pairs:
            return 0
        return min((len(found - pairs) for pairs in self.pairs.values()), default=len(found))


Rows = Iterable[tuple[str, str | None]]


def _characters(lang: str, rows: Rows) -> tuple[Counter, int]:
    """In how many texts each character beyond ASCII stands, and the number of texts."""
    raw, n = Counter(), 0
    for text, _ in rows:
        raw.update({ch for ch in text if ch > "\x7f"})
        n += 1
    return raw, n


def _sound_units(text: str, known: set[str]) -> list[str]:
    return [u for u in split_units(text) if u.isascii() or not structural(u, known)]


def _habits(lang: str, rows: Rows, known: set[str], usual: float) -> tuple[Counter, int, frozenset[str], frozenset[str]]:
    """Texts with each character, the number of texts, characters at home and usual pairs of one language."""
    chars, pairs, by_source, from_source, n = Counter(), Counter(), {}, Counter(), 0
    for text, source in rows:
        clean = [u for u in _sound_units(text, known) if not u.isascii()]
        chars.update({ch for u in clean for ch in u if ch > "\x7f"})
        found = {p for u in clean for p in high_pairs(u)}
        pairs.update(found)
        by_source.setdefault(source, Counter()).update(found)
        from_source[source] += 1
        n += 1
    often = {p for p, k in pairs.items() if k >= max(2, usual * n)}
    for source, own in by_source.items():
        rest = n - from_source[source]
        if rest >= LEAST:
            often = {p for p in often if not own[p] or pairs[p] - own[p] >= max(2, usual * rest)}
    return chars, n, frozenset(ch for ch, k in chars.items() if k >= max(2, AT_HOME * n)), frozenset(often)


def _dictionary(lang: str, rows: Rows, known: set[str], model: Model, strict: bool) -> bytes:
    """Dictionary of one language; empty if there is too little text."""
    return _trained(u for text, _ in rows for u in _teaching(_sound_units(text, known), model, strict))


def _teaching(units: Iterable[str], model: Model, strict: bool) -> Iterator[bytes]:
    """The sound units that a dictionary learns from, in the code of the model."""
    return (model.encode(u) for u in units if len(u) >= 8 and not (strict and not u.isascii() and model.unusual(u)))


def _trained(texts: Iterable[bytes]) -> bytes:
    import zstandard

    coded = list(texts)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, coded, k=128, d=8).as_bytes()
    except zstandard.ZstdError:
        whole = b"\n".join(coded)[-DICTIONARY_BYTES:]  # too little to train on: the text itself serves
        return whole if len(whole) >= 8 else b""


def _known(raw: Counter, n: int) -> set[str]:
    return {ch for ch, k in raw.items() if k >= max(2, SEEN * n)}


def _without_dictionaries(habits: dict[str, tuple[Counter, int, frozenset[str], frozenset[str]]]) -> Model:
    total, n = Counter(), sum(h[1] for h in habits.values())
    for c, *_ in habits.values():
        total.update(c)
    seen = sorted(_known(total, n), key=lambda ch: (-total[ch], ch))
    return Model(code_of(seen), {lang: h[2] for lang, h in habits.items()}, {lang: h[3] for lang, h in habits.items()}, {})


def fit_in_steps(each: Callable[[Callable], dict], usual: float, strict: bool) -> Model:
    """The model by three steps over the rows of each language; ``each`` applies a step to all languages."""
    counted = each(_characters)
    raw, n = Counter(), sum(k for _, k in counted.values())
    for c, _ in counted.values():
        raw.update(c)
    known = _known(raw, n)
    model = _without_dictionaries(each(lambda lang, rows: _habits(lang, rows, known, usual)))
    model.dictionaries = {lang: d for lang, d in each(lambda lang, rows: _dictionary(lang, rows, known, model, strict)).items() if d}
    return model


def code_of(seen: list[str]) -> dict[str, bytes]:
    """Two bytes for the first characters, three for the others."""
    two = 64 * 192
    short = {ch: bytes((128 + i // 192, 64 + i % 192)) for i, ch in enumerate(seen[:two])}
    return short | {ch: bytes((192 + i // 192**2, 64 + i // 192 % 192, 64 + i % 192)) for i, ch in enumerate(seen[two:])}


def _utf8_candidates(unit: str) -> dict[str, tuple[str, ...]]:
    """Texts reachable by undoing UTF-8 read in other encodings, with their chains (outermost first)."""
    found: dict[str, tuple[str, ...]] = {}
    layer = {unit: ()}
    while layer:  # every layer undone makes a text shorter
        nxt: dict[str, tuple[str, ...]] = {}
        for text, chain in layer.items():
            if text.isascii():
                continue
            # one byte a character: a sequence is a run of two or more; several bytes: wide characters
            for codec in SINGLE if _HIGH_RUN.search(text) else ():
                out = undo_utf8(text, codec)
                if out is not None and out not in found and out != unit:
                    nxt.setdefault(out, (*chain, codec))
            for codec in MULTI if _WIDE.search(text) else ():
                out = undo_utf8_multi(text, codec)
                if out is not None and out not in found and out != unit:
                    nxt.setdefault(out, (*chain, codec))
        found.update(nxt)
        layer = nxt
    return found


_ALL_LEGACY = [(w, r) for w in LEGACY_WRONG for r in LEGACY_RIGHT if w != r]
_ALL_LEGACY_MULTI = [(w, r) for w in ("cp1252", "latin-1", "cp437", "mac-roman", "cp1251") for r in LEGACY_MULTI]


def _exchanges(high: frozenset[str], model: Model) -> list[tuple[str, str]]:
    """Exchanges of older encodings that turn the characters into characters at home in one language, or into many bytes a character."""
    if high not in model._exchanges:
        if len(model._exchanges) > 50_000:
            model._exchanges.clear()
        out: dict[tuple[str, ...], tuple[str, str]] = {}  # exchanges that do the same to these characters count once
        chars = sorted(high)
        for w, r in _ALL_LEGACY:
            table = _legacy_map(w, r)
            new = tuple(table.get(ord(ch), ch) for ch in chars)
            if new not in out and new != tuple(chars) and (any(home.issuperset(new) for home in model.home.values()) or all(ch in model.code for ch in new)):
                out[new] = (w, r)
        many: dict[tuple, tuple[str, str]] = {}
        for w, r in _ALL_LEGACY_MULTI:
            if high <= _byte_set(w):
                many.setdefault((r, *(_as_bytes(w)[ord(ch)] for ch in chars)), (w, r))
        model._exchanges[high] = [*out.values(), *many.values()]
    return model._exchanges[high]


def _legacy_candidates(unit: str, model: Model, pairs=None, around: tuple[str, str] = ("", "")) -> dict[str, tuple[str, ...]]:
    """Texts reachable by one exchange of older encodings that some language is at home with, and that
    leave at most half of the unusual pairs; no more than before, where a word was mixed and is no longer. ``around``
    are the neighbours of a part of a unit."""
    found: dict[str, tuple[str, ...]] = {}
    before, after = around
    odd, strange = model.unusual(before + unit + after), mixed(unit)
    for w, r in _exchanges(frozenset(_HIGH.findall(unit)), model) if pairs is None else pairs:
        out = undo_legacy_multi(unit, w, r) if r in LEGACY_MULTI else undo_legacy(unit, w, r)
        if out is None or out in found:
            continue
        left = model.unusual(before + out + after)
        if not (2 * left <= odd or (strange and left <= odd)):
            continue
        worse = mixed(out)
        whole = strange and left <= odd and not worse
        if (whole or (2 * left <= odd and (strange or not worse))) and (not left or model.at_home(out) or (whole and all(ch in model.code for ch in _HIGH.findall(out)))):
            found[out] = (f"{w}<{r}",)
    return found


def _odd_parts(unit: str, model: Model) -> list[tuple[int, int]]:
    """Stretches of words with unusual pairs, unless they are the whole unit. Neighbours are in one stretch if both
    hold wide characters or neither does: those can't come from one byte each."""
    parts: list[tuple[int, int, bool]] = []
    for m in re.finditer(r"\S*[^\x00-\x7f]\S*", unit):
        if model.unusual(unit[max(0, m.start() - 1) : m.end() + 1]):
            wide = bool(_WIDE.search(m[0]))
            if parts and parts[-1][2] == wide and not unit[parts[-1][1] : m.start()].strip():
                parts[-1] = (parts[-1][0], m.end(), wide)
            else:
                parts.append((m.start(), m.end(), wide))
    return [(a, b) for a, b, _ in parts if b - a < len(unit.strip())]


def restore_unit(unit: str, model: Model, pairs=None) -> tuple[str, tuple[str, ...]]:
    """The unit in the form of least description length, and the chain undone (empty: unchanged)."""
    if unit.isascii() or not model.compressors or not model.unusual(unit):
        return unit, ()
    legacy = COST_LEGACY if pairs is None else COST_UTF8
    cost = lambda kind, before, after: COST_MIXED if mixed(before) and not mixed(after) else kind
    candidates = {t: (c, cost(COST_UTF8, unit, t) + COST_LAYER * (len(c) - 1)) for t, c in _utf8_candidates(unit).items()}
    for t, c in _legacy_candidates(unit, model, pairs).items():
        candidates.setdefault(t, (c, cost(legacy, unit, t)))
    best, length, chain = unit, None, ()
    if candidates:
        length = model.length(unit)[0] - MARGIN
        for text, (c, extra) in candidates.items():
            size = model.length(text)[0] + extra
            if size < length:
                best, length, chain = text, size, c
    if not best.isascii() and model.unusual(best):
        for a, b in reversed(_odd_parts(best, model)):  # from the end, so that places before stay
            options = _legacy_candidates(best[a:b], model, pairs, (best[max(0, a - 1) : a], best[b : b + 1]))
            if not options:
                continue
            least, text, undone = model.length(best)[0] - MARGIN, best, ()
            for t, c in options.items():
                whole = best[:a] + t + best[b:]
                size = model.length(whole)[0] + cost(legacy, best[a:b], t)
                if size < least:
                    least, text, undone = size, whole, c
            best, chain = text, chain + tuple(x for x in undone if x not in chain)
    return best, chain


def restore(text: str, model: Model) -> tuple[str, list[str], bool]:
    """Restored text, chains undone, and whether anything was garbled (restorable or not)."""
    if text.isascii():
        return text, [], False
    units = split_units(text)
    done = [restore_unit(u, model) for u in units]
    legacy = sorted({x for _, c in done for x in c if "<" in x})
    if legacy:  # the document shows an exchange of encodings: try it on its other units too
        pairs = [tuple(x.split("<")) for x in legacy]
        done = [d if d[1] or u.isascii() else restore_unit(u, model, pairs) for u, d in zip(units, done)]
    whole = "".join(t for t, _ in done)
    lost = [LOST] if "�" in text else []
    chains = sorted({"+".join(c) for _, c in done if c}) + lost
    return whole, chains, bool(chains)


def fit_model(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", source: str = "source") -> Model:
    """Model from all texts of the table. Languages beyond the ``OWN`` most frequent, those of fewer than ``LEAST`` texts
    and rows without a language are one group, if it has ``LEAST`` texts. A wrong language
    here and there only blurs a dictionary. A column ``source``, if there is one, keeps a single source from
    making its pairs usual. Shards go by hash, so the model is the same however the table is laid out. The driver sees counts,
    usual pairs and dictionaries alone."""
    named = docs.where(F.col(text).isNotNull())
    sizes = named.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars"))
    own = {r.lang: r.chars for r in sizes.where(F.col("lang").isNotNull() & (F.col("n") >= LEAST)).orderBy(F.desc("n"), "lang").limit(OWN).collect()}
    others = sizes.where(F.col("lang").isNull() | ~F.col("lang").isin(list(own))).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).first()
    if others.n and others.n >= LEAST:
        own[REST] = others.chars
    if not own:
        return Model({}, {}, {}, {})
    shards = {name: max(1, math.ceil(chars / SHARD_CHARS)) for name, chars in own.items()}
    group = F.when(F.col(lang).isin(list(own)), F.col(lang)).otherwise(REST)
    origin = F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")
    rows = named.select(F.col(doc_id).cast("long").alias("doc_id"), group.alias("lang"), origin.alias("source"), F.col(text).cast("string").alias("text")).where(F.col("lang").isin(list(own)))

    marks = rows.where(F.col("text").rlike("[^\\x00-\\x7f]")).select("text").mapInArrow(_marked, "item string, k long").groupBy("item").agg(F.sum("k").alias("k"))
    known = _known({r["item"]: r.k for r in marks.collect()}, rows.count())
    parted = rows.withColumn("key", F.xxhash64("text")).mapInArrow(lambda it: _soundly(it, known), "doc_id long, lang string, source string, key long, units array<string>")
    parted = cut(parted, "encoding-units")
    first = _fitted(parted, shards, USUAL_FIRST, strict=True)
    bad = cut(garbled_texts(rows, first).select("doc_id").distinct(), "encoding-garbled")
    return _fitted(parted.join(bad, "doc_id", "left_anti"), shards, USUAL_PAIR, strict=False)


def _fitted(parted: DataFrame, shards: dict[str, int], usual: float, strict: bool) -> Model:
    """The model of rows ``doc_id, lang, source, key, units``, as :func:`fit_in_steps` makes it."""
    counts = parted.select("lang", "source", "units").mapInArrow(_tallied, "lang string, source string, kind string, item string, k long")
    counts = cut(counts.groupBy("lang", "source", "kind", "item").agg(F.sum("k").alias("k")), "encoding-counts")
    n = counts.where("kind = 'n'").groupBy("lang").agg(F.sum("k").alias("n"))
    texts = {r.lang: r.n for r in n.collect()}
    chars: dict[str, Counter] = {name: Counter() for name in texts}
    for r in counts.where("kind = 'c'").groupBy("lang", "item").agg(F.sum("k").alias("k")).collect():
        chars[r.lang][r["item"]] = r.k
    # a pair must be usual without any one source, if enough texts come from others
    of_source = counts.where("kind = 'n'").select("lang", F.col("source").alias("from"), F.col("k").alias("own"))
    pairs = counts.where("kind = 'p'").join(F.broadcast(n), "lang")
    pairs = pairs.join(of_source.withColumnRenamed("lang", "of"), (F.col("lang") == F.col("of")) & F.col("source").eqNullSafe(F.col("from")))
    pairs = pairs.withColumns({"all": F.sum("k").over(Window.partitionBy("lang", "item")), "rest": F.col("n") - F.col("own")})
    alone = (F.col("rest") >= LEAST) & (F.col("all") - F.col("k") < F.greatest(F.lit(2.0), F.lit(usual) * F.col("rest")))
    often = pairs.where(F.col("all") >= F.greatest(F.lit(2.0), F.lit(usual) * F.col("n"))).groupBy("lang", "item").agg(F.max(alone).alias("alone")).where("not alone")
    known_pairs: dict[str, set[str]] = {name: set() for name in texts}
    for r in often.select("lang", "item").collect():
        known_pairs[r.lang].add(r["item"])
    order = [name for name in shards if name in texts]
    at_home = {name: frozenset(ch for ch, k in chars[name].items() if k >= max(2, AT_HOME * texts[name])) for name in order}
    model = _without_dictionaries({name: (chars[name], texts[name], at_home[name], frozenset(known_pairs[name])) for name in order})

    number = F.coalesce(*[F.when(F.col("lang") == name, F.lit(k)) for name, k in shards.items()])
    made = parted.withColumn("shard", F.pmod(F.xxhash64("doc_id", "key"), number).cast("int"))
    most, schema = max(shards.values()), "lang string, shard int, raw binary"
    made = made.repartition(2 * sum(shards.values()), "lang", "shard").groupBy("lang", "shard").applyInArrow(lambda t: _shard_dictionary(t, model, strict), schema)
    made = cut(made, "encoding-dictionaries")
    while most > 1:
        most = math.ceil(most / MERGED)
        made = made.withColumn("to", F.floor(F.col("shard") / MERGED).cast("int")).groupBy("lang", "to").applyInArrow(_merged, schema)
        made = cut(made, "encoding-dictionaries")
    found = {r.lang: bytes(r.raw) for r in made.collect() if r.raw}
    model.dictionaries = {name: found[name] for name in order if name in found}
    return model


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each character beyond ASCII stands; part counts."""
    count = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            count.update({ch for ch in t if ch > "\x7f"})
    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["item", "k"])


def _soundly(batches: Iterator[pa.RecordBatch], known: set[str]) -> Iterator[pa.RecordBatch]:
    """The texts as their sound units."""
    for b in batches:
        units = pa.array([_sound_units(t, known) for t in b.column("text").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "lang", "source", "key")), units], names=["doc_id", "lang", "source", "key", "units"])


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Part counts of texts (``n``), of texts with a character (``c``) and with a pair (``p``) in sound units, by language and source."""
    count = Counter()

    def passed_on() -> pa.RecordBatch:
        columns = list(zip(*count)) or [[]] * 4
        texts = [pa.array(c, pa.string()) for c in columns]
        return pa.RecordBatch.from_arrays([*texts, pa.array(list(count.values()), pa.int64())], names=["lang", "source", "kind", "item", "k"])

    for b in batches:
        for lang, source, units in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "units"))):
            high = [u for u in units if not u.isascii()]
            count[lang, source, "n", ""] += 1
            count.update((lang, None, "c", ch) for ch in {ch for u in high for ch in u if ch > "\x7f"})
            count.update((lang, source, "p", p) for p in {p for u in high for p in high_pairs(u)})
            if len(count) > HELD:
                yield passed_on()
                count.clear()
    yield passed_on()


def _shard_dictionary(t: pa.Table, model: Model, strict: bool) -> pa.Table:
    """Dictionary of a shard, its texts in the order of their ids, so that the result is the same every time."""
    t = t.sort_by([("doc_id", "ascending"), ("key", "ascending")])
    raw = _trained(b for units in t.column("units").to_pylist() for b in _teaching(units, model, strict))
    return pa.table({"lang": t.column("lang")[:1], "shard": t.column("shard")[:1], "raw": pa.array([raw], pa.binary())})


def _merged(t: pa.Table) -> pa.Table:
    """One dictionary trained on the content of others, which ends with the most useful; a lone one stays."""
    t = t.sort_by("shard")
    raws = [r for r in t.column("raw").to_pylist() if r]
    pieces = [r[max(0, i - PIECE) : i] for r in raws for i in range(len(r), 0, -PIECE)]
    raw = _trained(pieces) if len(raws) > 1 else b"".join(raws)
    return pa.table({"lang": t.column("lang")[:1], "shard": t.column("to")[:1], "raw": pa.array([raw], pa.binary())})


def _restored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    model = model.open()
    for b in batches:
        rows = [restore(t, model) for t in b.column(1).to_pylist()]
        at = [i for i, r in enumerate(rows) if r[2]]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0).take(pa.array(at, pa.int64())),
                pa.array([rows[i][1] for i in at], pa.list_(pa.string())),
                pa.array([rows[i][0] for i in at], pa.string()),
                pa.array(["�" not in rows[i][0] for i in at], pa.bool_()),
            ],
            names=["doc_id", "chains", "restored_text", "restorable"],
        )


def garbled_texts(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, chains, restored_text, restorable)`` of the affected documents, one narrow stage.

    Null and empty texts are unaffected; repeated ids come out as often as they come in. With a
    model of no language nothing but replacement characters is reported.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]"))
    return rows.mapInArrow(lambda it: _restored(it, model), "doc_id long, chains array<string>, restored_text string, restorable boolean")
