"""Spellings of organisation names that mean the same organisation.

1. Names are folded (accents, case, punctuation, camel case) into tokens. What is no organisation's
   own is learnt from the names (:func:`learn_words`): generic words are frequent and stand beside
   many other words; short forms and synonyms take a generic word's place in names that are else
   alike; noise comes and goes in the names of several organisations; generic words that never stand
   together are rivals. There is no list of words. What remains, the rare tokens, decides.
2. Candidates come from a set-similarity join on the padded q-grams of the rare tokens, each gram
   weighing as it is rare. A pair must share ``SHARED`` of the weight of the lighter set, so only the
   grams at the front of the order of rarity are looked up, and only where enough weight of the other
   set lies behind (prefix and position filter). Grams in many names are looked up in blocks.
3. Candidates are verified by soft token similarity: tokens are aligned by edit distance, as prefix
   or vowelless abbreviations or as run-together words, and each alignment and each token left over
   weighs as its token is rare. Names with rival generic words don't match.
4. Sure links form components. An abbreviated spelling joins the one component it fits; one that
   fits several best is left alone, for it would tie organisations together.

Nothing is capped: every name is indexed and every candidate verified. What is learnt is bounded by
shares of the names (``GENERIC_SHARE``, ``WORD_SHARE``), so it can be collected and shipped.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netledger.session import cut

Q = 4
#: Tokens in at least this share of all names (and in GENERIC_LEAST names) may be generic, if OTHERS of
#: the names they stand in hold a rare word besides.
GENERIC_SHARE, GENERIC_LEAST, OTHERS = 0.03, 12, 0.5
#: Tokens below this share of the names (or 2 names) count as equally rare and are no short forms.
WORD_SHARE = 1e-4
#: Share of the organisations with a short form in which the generic word stands in its place.
IN_PLACE = 0.4
#: Generic words that stand together in less than this part of what chance would have are rivals.
TOGETHER = 0.2
#: Share of the weight of the lighter gram set that must recur in the other.
SHARED = 0.35
#: Names looked up at once for one gram.
BLOCK = 5_000
#: Least soft similarity of a link.
SURE = 0.85
#: Bits that a letter tells, that a slip takes, and those that a link with slips must have to spare, sure or abbreviated.
LETTER, SLIP, SAFE, LIKELY = 3.0, 6.0, 7.0, 2.0

_FOLD = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "ı": "i"})
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_MARK = re.compile(r"^(?:AS|as|As)[-_ ](?=\S)|[-_ ](?:AS|as|As)$")


def fold(name: str) -> str:
    """Without accents, format characters and compatibility forms."""
    text = unicodedata.normalize("NFKD", name).translate(_FOLD)
    return "".join(ch for ch in text if not unicodedata.combining(ch) and unicodedata.category(ch) != "Cf")


def tokens(name: str) -> list[str]:
    """Lower-case tokens in order; dots, slashes and apostrophes inside a token vanish, so G.m.b.H. is gmbh."""
    text = _MARK.sub("", fold(name).strip())
    out = []
    for part in re.split(r"[^\w./'’&]+|_", text):
        for piece in _CAMEL.split(part) if not part.isupper() else [part]:
            clean = re.sub(r"[\W_]", "", piece).lower()
            if clean:
                out.append(clean)
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours; most + 1 as soon as it is sure to exceed ``most``."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    before, last = None, list(range(lb + 1))
    for i in range(1, la + 1):
        row = [i] + [0] * lb
        ca = a[i - 1]
        for j in range(1, lb + 1):
            cost = last[j - 1] + (ca != b[j - 1])
            if last[j] + 1 < cost:
                cost = last[j] + 1
            if row[j - 1] + 1 < cost:
                cost = row[j - 1] + 1
            if before and j > 1 and ca == b[j - 2] and a[i - 2] == b[j - 1] and before[j - 2] + 1 < cost:
                cost = before[j - 2] + 1
            row[j] = cost
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[lb]


def _skeleton(word: str) -> str:
    return word[:1] + re.sub("[aeiouy]", "", word[1:])


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(ch in it for ch in short)


@dataclass
class Words:
    """What the names teach about their words."""

    total: int = 1
    meanings: dict[str, tuple[str, ...]] = field(default_factory=dict)  # generic words, short forms; noise means nothing
    rivals: set[tuple[str, str]] = field(default_factory=set)
    counts: dict[str, int] = field(default_factory=dict)

    def weight(self, token: str) -> float:
        """Rarity of a token among the names."""
        return math.log(1 + self.total / self.counts.get(token, max(1.0, WORD_SHARE * self.total)))

    def generic(self, token: str) -> tuple[str, ...] | None:
        """The generic words that a token is, shortens or misspells."""
        if token in self.meanings:
            return self.meanings[token]
        if len(token) < 3:
            return None
        for word, meaning in self.meanings.items():
            if len(word) < 5 or word[0] != token[0] or not meaning:
                continue
            if len(token) >= 4 and (word.startswith(token) or (len(token) >= 5 and edits(token, word, 1) <= 1)):
                return meaning
            if shortens(token, word):
                return meaning
        return None

    def compatible(self, a: list[str], b: list[str]) -> bool:
        """No generic word of one is a rival of one of the other that the first lacks."""
        left, right = set(a) - set(b), set(b) - set(a)
        return not any((u, v) in self.rivals for u in left for v in right)


def shortens(short: str, long: str) -> bool:
    """``short`` is ``long`` without some of its vowels, three letters at least."""
    return 3 <= len(short) < len(long) and short[0] == long[0] and _within(short, long) and _within(_skeleton(long), short)


def parse(name: str, words: Words) -> tuple[list[str], list[str]]:
    """Rare tokens and generic words of a name, both sorted."""
    rare, generic, split = [], [], tokens(name)
    for i in range(len(split) - 1, 0, -1):  # a generic word written as two
        if words.meanings.get(whole := split[i - 1] + split[i]) == (whole,):
            split[i - 1 : i + 1] = [whole]
    for t in split:
        meaning = words.generic(t)
        if meaning is None:
            rare.append(t)
        else:
            generic.append((t, meaning))
    if len(rare) < 2:  # what merely resembles a generic word, or shortens one, may be a rare word after all
        fuzzy = [x for x in generic if x[0] not in words.meanings]
        like = fuzzy or [x for x in generic if x[1] and x[0] not in x[1] and len(x[0]) <= 4 and x[1][0].startswith(x[0])]
        if like and (len(generic) > 1 or (rare and len(rare[0]) <= (10 if fuzzy else 7))):
            rare.append(like[0][0])
            generic.remove(like[0])
    return sorted(rare), sorted({m for _, meaning in generic for m in meaning})


def grams(rare: list[str]) -> list[str]:
    """Padded q-grams of each rare token and its first two letters, which abbreviations keep; a set."""
    out = set()
    for t in rare:
        padded = f"^{t}$"
        out.update(padded[i : i + Q] for i in range(max(1, len(padded) - Q + 1)))
        out.add(padded[:3] + "<")
    return sorted(out)


def _same(a: str, b: str) -> float:
    """Likeness of two tokens: 1 equal, 0.9 a slip, 0.6 one cut short, 0 neither."""
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    slips = 2 if len(short) >= 9 else 1
    if (len(short) >= 4 and edits(a, b, slips) <= slips) or shortens(short, long):
        return 0.9
    if 2 <= len(short) < len(long) and long.startswith(short):
        return 0.6
    if 3 <= len(short) <= len(long) - 2 and short[0] == long[0] and edits(short, long[: len(short)], 1) <= 1 and len(short) >= 4:
        return 0.5
    if len(short) == 3 and len(long) == 4 and short[0] == long[0] and edits(short, long, 1) <= 1:
        return 0.9
    return 0.0


def _cut_inside(short: str, long: str) -> bool:
    """Is ``short`` the begin of ``long``, two letters at least, and its end, four at least?"""
    return len(long) - len(short) >= 2 and any(long.startswith(short[:k]) and long.endswith(short[k:]) for k in range(2, len(short) - 3))


def soft_similarity(a: list[str], b: list[str], weight=lambda t: 1.0) -> float:
    """Soft weighted similarity of two lists of rare tokens.

    Tokens are aligned with their likest; the aligned weight by its likeness is set against all
    weight. ``SURE`` or more is a sure link. At most one token may be cut short; if counting it as
    whole makes the link sure, 0.5 to 0.7 tell how good the abbreviation is (0.1 better if another
    token is equal). Otherwise 0.
    """
    if len(a) > len(b):
        a, b = b, a
    if a == b:
        return 1.0
    if len(a) == 1 and len(b) == 1:
        short, long = sorted((a[0], b[0]), key=len)
        if len(short) >= 8 and edits(short, long, 1) <= 1:
            return 0.9
        return 0.6 if _cut_inside(short, long) else 0.0
    if len(a) == 1 and len(b) == 2:
        x, best = a[0], 0.0
        for u, v in (b, b[::-1]):
            if abs(len(x) - len(u) - len(v)) <= 1 and edits(x, u + v, 1) <= 1:
                return 0.9
            if 2 <= len(u) and 4 <= len(v) and len(x) - len(u) - len(v) >= 2 and x.startswith(u) and x.endswith(v):
                best = max(best, 0.6)
            for k in range(2, len(u)):
                if x == u[:k] + v:
                    best = max(best, 0.7)
                elif len(v) >= 4 and abs(len(x) - k - len(v)) <= 1 and best < 0.55 and edits(x, u[:k] + v, 1) <= 1:
                    best = 0.55
        return best
    free = list(b)
    total = sum(map(weight, a)) + sum(map(weight, b))
    gained = whole = 0.0
    cuts, aligned = [], 0
    for x in sorted(a, key=len, reverse=True):
        s, y = max(((_same(x, y), y) for y in free), default=(0.0, ""))
        if not s:
            continue
        free.remove(y)
        aligned += 1
        w = weight(x) + weight(y)
        gained += s * w
        whole += (s if s >= SURE else 1.0) * w
        if s < SURE:
            cuts.append(s)
    if aligned < 2 or len(cuts) > 1 or whole < SURE * total:
        return 0.0
    if cuts:
        return cuts[0] + 0.1 * bool(set(a) & set(b))
    return gained / total


def _slips(a: list[str], b: list[str], cut_short: bool) -> int:
    """How many tokens of the shorter name are no token of the other, but for one that is cut short."""
    a, b = sorted((a, b), key=lambda r: sum(map(len, r)))
    if 1 in (len(a), len(b)):
        x, y = sorted((a, b), key=len)
        if x == y or (len(y) == 2 and x[0] in (y[0] + y[1], y[1] + y[0])):
            return 0
        if cut_short:
            return int(not (_cut_inside(*sorted((x[0], y[0]), key=len)) if len(y) == 1 else any(x[0].endswith(e) for e in y)))
        return 1
    return max(0, len(set(a) - set(b)) - cut_short)


def weighed(score: float, a: list[str], b: list[str], shared: list[str], words: Words) -> float:
    """``score`` of two lists of rare tokens, less if slips make it likely that another name is meant.

    Among many names some differ by a letter and are others. What agrees is set against the number of names:
    a letter says ``LETTER`` bits, a slip takes ``SLIP``, shared generic words say what their rarity does. A sure
    link needs ``SAFE`` bits beyond the logarithm of the number, else it counts as 0.5; an abbreviation that also
    slips needs ``LIKELY``.
    """
    slips = _slips(a, b, score < SURE)
    if not slips:
        return score
    letters = min(sum(map(len, a)), sum(map(len, b)))
    spare = LETTER * letters - SLIP * slips + sum(map(words.weight, shared)) / math.log(2) - math.log2(max(2, words.total))
    if score >= SURE:
        return score if spare >= SAFE else 0.5
    return score if spare >= LIKELY else 0.0


_NODE = "name string, rare array<string>, generic array<string>, grams array<string>"


def _parsed(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = b.column(0).to_pylist()
        rows = [parse(n, words) for n in names]
        texts = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array([r[i] for r in rows], texts) for i in (0, 1)), pa.array([grams(r[0]) for r in rows], texts)],
            names=["name", "rare", "generic", "grams"],
        )


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sorted(set(tokens(n))) for n in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["toks"])


def _parted(batches: Iterator[pa.RecordBatch], meanings: dict[str, tuple[str, ...]]) -> Iterator[pa.RecordBatch]:
    """Tokens of each name as generic words and the rest."""
    texts = pa.list_(pa.string())
    for b in batches:
        rows = b.column("toks").to_pylist()
        own = [sorted({m for t in r if t in meanings for m in meanings[t]}) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(own, texts), pa.array([[t for t in r if t not in meanings] for r in rows], texts)], names=["own", "rest"])


def _stands_for(token: str, word: str) -> bool:
    """One of the two is written with letters of the other, in order and from the first."""
    return token[0] == word[0] and (_within(token, word) or _within(word, token))


def _array(values) -> F.Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _spelling(c: str) -> F.Column:
    return F.xxhash64(F.array_join(F.array_sort(c), " "))


def _union(c: str) -> F.Column:
    return F.array_distinct(F.flatten(F.collect_set(c)))


def _pair_counts(sets: DataFrame) -> dict[tuple[str, str], int]:
    """In how many sets ``own`` of generic words two stand together, and each (with itself)."""
    two = sets.select(F.explode("own").alias("u"), "own").select("u", F.explode("own").alias("v")).where("u <= v")
    return {(r.u, r.v): r["count"] for r in two.groupBy("u", "v").count().collect()}


def learn_words(toks: DataFrame, total: int) -> Words:
    """Generic words, their short forms, noise, rivals and frequent tokens of names; ``toks`` has each name's distinct tokens.

    A frequent word of one organisation's own stands with hardly any rare word but misspellings,
    so it isn't generic however many spellings the organisation has. A token in whose place a generic
    word stands in the names of two or more organisations (``IN_PLACE`` of those where it is left out;
    of one, if the letters agree) is a short form; one that is left out by three or more is noise.
    """
    one = toks.select(F.explode("toks").alias("t"))
    frequent = one.groupBy("t").count().where(F.col("count") >= max(2.0, WORD_SHARE * total))  # at most tokens a name / WORD_SHARE
    counts = {r.t: r["count"] for r in frequent.collect()}
    words = Words(total, counts=counts)
    often = [t for t, k in counts.items() if k >= max(GENERIC_LEAST, GENERIC_SHARE * total)]  # at most tokens a name / GENERIC_SHARE
    if not often:
        return words
    some = F.array_intersect("toks", _array(often))
    beside = F.exists(F.array_except("toks", _array(often)), lambda x: F.length(x) >= 4)
    of_many = toks.where(beside).select(F.explode(some).alias("t")).groupBy("t").count().collect()
    generic = sorted(r.t for r in of_many if r["count"] >= OTHERS * counts[r.t])
    words.meanings = {t: (t,) for t in sorted(generic, key=lambda t: (-counts[t], t))}

    parts = toks.mapInArrow(lambda it, m=dict(words.meanings): _parted(it, m), "own array<string>, rest array<string>")
    alike = parts.where(F.size("rest") > 0).groupBy(_spelling("rest").alias("key")).agg(_union("own").alias("own"))
    together, in_one = _pair_counts(parts), _pair_counts(alike)
    for i, u in enumerate(generic):
        for v in generic[i + 1 :]:
            if together.get((u, v), 0) >= TOGETHER * counts[u] * counts[v] / total:
                continue
            if in_one.get((u, v), 0) >= TOGETHER * min(in_one.get((u, u), 0), in_one.get((v, v), 0)) > 0:  # one organisation uses both
                rarer, other = sorted((u, v), key=lambda t: (counts[t], t))
                words.meanings[rarer] = words.meanings[other]
            else:
                words.rivals |= {(u, v), (v, u)}

    while found := _stand_ins(toks, words, frequent):  # a new word may uncover others, as of forms of two words
        words.meanings |= found
    return words


def _stand_ins(toks: DataFrame, words: Words, frequent: DataFrame) -> dict[str, tuple[str, ...]]:
    """Tokens in whose place generic words stand, or nothing, in names that are else alike.

    What remains of a name without the token tells the organisation; names that are just that show
    what stands there else.
    """
    parts = toks.mapInArrow(lambda it, m=dict(words.meanings): _parted(it, m), "own array<string>, rest array<string>").where(F.size("rest") > 0)
    left = parts.where(F.size("rest") > 1).select(F.explode("rest").alias("t"), "rest", "own").join(frequent.select("t"), "t", "left_semi")
    left = left.select("t", _spelling(F.array_remove("rest", F.col("t"))).alias("key"), "own").groupBy("t", "key").agg(_union("own").alias("own"))
    right = parts.groupBy(_spelling("rest").alias("key")).agg(_union("own").alias("else"))
    met = left.join(right, "key").select("t", "key", F.explode_outer(F.array_except("else", "own")).alias("word"))
    counted = met.groupBy("t", "word").agg(F.countDistinct("key").alias("k")).groupBy("t").agg(F.collect_list(F.struct("word", "k")).alias("words"))
    organisations = met.groupBy("t").agg(F.countDistinct("key").alias("n"))
    out = {}
    for r in organisations.join(counted, "t", "left").orderBy("t").collect():
        meant = tuple(sorted(x.word for x in r.words if x.word and x.k >= IN_PLACE * r.n and (x.k > 1 or _stands_for(r.t, x.word))))
        if meant or r.n >= 3:
            out[r.t] = meant
    return out


def _verified(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[pa.RecordBatch]:
    """Links among candidate pairs; shared generic words make a score better by 0.01 each, 0.03 at most."""
    for b in batches:
        keep, scores = [], []
        for i, (ra, ga, rb, gb) in enumerate(zip(*(b.column(c).to_pylist() for c in range(2, 6)))):
            s = soft_similarity(ra, rb, words.weight)
            if s and words.compatible(ga, gb):
                both = sorted(set(ga) & set(gb))
                s = weighed(s, ra, rb, both, words)
                if s:
                    keep.append(i)
                    scores.append(s + 0.01 * min(3, len(both)))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(scores, pa.float64())], names=["a", "b", "score"])


def components(nodes: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """``(id, comp)``: connected components; ``comp`` is the least id. ``links`` has ``a, b``.

    Labels spread from neighbour to neighbour and then jump to the label of their label, so the
    number of rounds is logarithmic in a component's width. Each round is written to the shared folder.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "id")
    labels = cut(labels, f"{name}-0")
    i = 0
    while True:
        i += 1
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("comp", "near").alias("new"), F.col("comp").alias("old"))
        up = step.select(F.col("id").alias("up_id"), F.col("new").alias("up"))
        jumped = step.join(up, step.new == up.up_id, "left").select("id", F.least("new", F.coalesce("up", "new")).alias("comp"), "old")
        jumped = cut(jumped, f"{name}-{i}")
        moved = jumped.where(F.col("comp") != F.col("old")).limit(1).count()
        labels = jumped.select("id", "comp")
        if not moved:
            break
    return nodes.join(labels, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose shared grams weigh ``need``; a gram and its pair are one number, looked up in all of the other side."""
    for b in batches:
        rows = np.arange(b.num_rows)
        coded = []
        for c in ("g_a", "g_b"):
            row = np.repeat(rows, b.column(c).value_lengths().to_numpy(zero_copy_only=False))
            coded.append((row, b.column(c).flatten().to_numpy(zero_copy_only=False) * 31 + row * 0x1E3779B97F4A7C15))
        (row, ours), (_, theirs) = coded
        theirs = np.sort(theirs)
        shared = theirs[np.minimum(np.searchsorted(theirs, ours), max(0, len(theirs) - 1))] == ours if len(theirs) else np.zeros(0, bool)
        weight = np.bincount(row[shared], b.column("w_a").flatten().to_numpy(zero_copy_only=False)[shared], minlength=b.num_rows)
        at = pa.array(np.flatnonzero(weight >= b.column("need").to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], names=["a", "b"])


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """``(a, b)`` of ``nodes`` (``node, grams``) whose grams share ``SHARED`` of the weight of the lighter set.

    A gram weighs the logarithm of its rarity. In the order of rarity, the first gram two sets share
    lies where at least that weight is left in either.
    """
    n = nodes.count()
    posted = nodes.select("node", F.explode("grams").alias("g"))
    df = posted.groupBy("g").agg(F.count(F.lit(1)).alias("df")).withColumn("w", F.log1p(F.lit(float(n)) / F.col("df")))
    by_rarity = Window.partitionBy("node").orderBy("df", "g")
    left = F.sum("w").over(by_rarity.rowsBetween(0, Window.unboundedFollowing))
    ranked = posted.join(df, "g").withColumns({"left": left, "total": F.sum("w").over(Window.partitionBy("node"))})
    ranked = cut(ranked.withColumn("blocks", F.ceil(F.col("df") / BLOCK).cast("int")), "name-grams")
    need = F.lit(SHARED) * F.col("total") - 1e-9
    probes = ranked.where(F.col("left") >= need).select(F.col("node").alias("a"), "g", need.alias("need"), F.col("total").alias("ta"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    index = ranked.select(F.col("node").alias("b"), "g", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "left", F.col("total").alias("tb"))
    heavier = (F.col("tb") > F.col("ta")) | ((F.col("tb") == F.col("ta")) & (F.col("b") > F.col("a")))
    met = probes.join(index, ["g", "block"]).where(heavier & (F.col("left") >= F.col("need"))).select("a", "b", "need").distinct()
    sets = ranked.groupBy("node").agg(F.collect_list(F.struct(F.xxhash64("g").alias("g"), "w")).alias("set")).select("node", "set.g", "set.w")
    full = met.join(sets.toDF("a", "g_a", "w_a"), "a").join(sets.select("node", "g").toDF("b", "g_b"), "b")
    return full.select("a", "b", "need", "g_a", "w_a", "g_b").mapInArrow(_similar, "a long, b long")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each token as it is and without any one of its letters."""
    for b in batches:
        rows = [(t, v) for t in b.column(0).to_pylist() for v in {t} | {t[:i] + t[i + 1 :] for i in range(len(t))}]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["t", "v"])


def slip_pairs(nodes: DataFrame) -> DataFrame:
    """``(a, b)`` of ``nodes`` (``node, rare``) of which one token differs by a letter (one more, less, other or swapped) and
    another begins with the same two letters.

    A short token with a slip keeps few grams, and where the other token is cut short, grams don't tell. Tokens meet
    first, each once, on what is left without a letter; so tokens of many names are joined with their misspellings alone.
    """
    spread = nodes.select("node", F.explode("rare").alias("t"), "rare")
    spread = spread.select("node", "t", F.explode(F.array_distinct(F.transform(F.array_except("rare", F.array("t")), lambda u: F.substring(u, 1, 2)))).alias("two"))
    spread = cut(spread.where(F.length("t") >= 3), "name-beside")
    left = cut(spread.select("t").distinct().mapInArrow(_variants, "t string, v string"), "name-variants")
    near = left.toDF("t", "v").join(left.toDF("u", "v"), "v").where(F.col("t") < F.col("u")).select("t", "u").distinct()
    near = near.where(F.abs(F.length("t") - F.length("u")) <= 1)
    met = near.join(spread.withColumnRenamed("node", "x"), "t").join(spread.toDF("y", "u", "two"), ["u", "two"])
    return met.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def link_names(names: DataFrame) -> DataFrame:
    """``(name, org)`` for a column ``name`` of distinct names: spellings of one organisation share ``org``.

    Null names and empty texts without any token are dropped from linking and stay alone. Repeated
    names count once; extra columns are ignored; an empty table gives no rows.
    """
    base = names.select(F.col("name").cast("string").alias("name")).where(F.col("name").isNotNull()).distinct()
    base = cut(base, "names")
    total = base.count()
    words = learn_words(cut(base.mapInArrow(_tokenized, "toks array<string>"), "name-tokens"), max(1, total))

    # spellings that differ only in what folding removes are one node
    parsed = base.mapInArrow(lambda it: _parsed(it, words), _NODE)
    keyed = cut(parsed.withColumn("node", F.xxhash64(F.array_join("rare", " "), F.lit("|"), F.array_join("generic", " "))), "name-nodes")
    nodes = keyed.groupBy("node").agg(*(F.first(c).alias(c) for c in ("rare", "generic", "grams"))).where(F.size("rare") > 0)
    nodes = cut(nodes, "name-node-table")

    sets = nodes.select("node", "rare", "generic")
    pairs = candidate_pairs(nodes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.unionByName(slip_pairs(nodes)).distinct()
    full = pairs.join(sets.toDF("a", "rare_a", "generic_a"), "a").join(sets.toDF("b", "rare_b", "generic_b"), "b")
    scored = full.select("a", "b", "rare_a", "generic_a", "rare_b", "generic_b").mapInArrow(lambda it: _verified(it, words), "a long, b long, score double")
    scored = cut(scored, "name-links")

    sure = scored.where(F.col("score") >= SURE).select("a", "b")
    ids = nodes.select(F.col("node").alias("id"))
    comp = cut(components(ids, sure, "names"), "name-components")
    # abbreviations: the component whose best score is highest, if it is alone at the top; of as many letters, if both choose each other
    weak = scored.where(F.col("score") < SURE)
    one = weak.select(F.col("a").alias("x"), F.col("b").alias("y"), "score").unionByName(weak.select(F.col("b").alias("x"), F.col("a").alias("y"), "score"))
    cx, cy = comp.toDF("x", "comp_x"), comp.toDF("y", "comp_y")
    size = nodes.select(F.col("node"), F.length(F.array_join("rare", "")).alias("letters"))
    longest = comp.join(size, comp.id == size.node).groupBy("comp").agg(F.max("letters").alias("letters"))
    lx, ly = longest.toDF("comp_x", "letters_x"), longest.toDF("comp_y", "letters_y")
    reach = one.join(cx, "x").join(cy, "y").where(F.col("comp_x") != F.col("comp_y")).groupBy("comp_x", "comp_y").agg(F.max("score").alias("score"))
    reach = reach.join(lx, "comp_x").join(ly, "comp_y").where(F.col("letters_x") <= F.col("letters_y"))
    top = Window.partitionBy("comp_x")
    best = reach.withColumn("top", F.max("score").over(top)).where(F.col("score") >= F.col("top") - 1e-9)
    best = best.withColumn("rivals", F.count(F.lit(1)).over(top)).where(F.col("rivals") == 1)
    best = cut(best.select(F.col("comp_x").alias("a"), F.col("comp_y").alias("b"), (F.col("letters_x") == F.col("letters_y")).alias("even")), "name-best")
    even = best.where("even").select("a", "b")
    best = best.where("not even").select("a", "b").unionByName(even.join(even.toDF("b", "a"), ["a", "b"]))
    final = components(comp.select(F.col("comp").alias("id")).distinct(), best, "name-short")
    org = comp.join(final.toDF("comp", "org"), "comp").select(F.col("id").alias("node"), "org")
    # generic words alone: what folds to the same words is one; without any word a name stays alone
    generic = F.when(F.size("generic") > 0, F.xxhash64(F.lit("generic"), "node"))
    named = keyed.select("name", "node", generic.alias("generic")).join(org, "node", "left")
    return named.select("name", F.coalesce("org", "generic", F.xxhash64(F.lit("alone"), "name")).alias("org"))


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """All pairs ``(name_a, name_b)`` with ``name_a < name_b`` by code point in each organisation."""
    a, b = linked.toDF("name_a", "org"), linked.toDF("name_b", "org")
    return a.join(b, "org").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
