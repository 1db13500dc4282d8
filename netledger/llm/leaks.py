"""Passages of held-out test items inside a training corpus.

Both operators read the corpus in narrow scans: texts become word hashes in the task that reads them,
and only the pairs that were found leave it. No text and no list of words is shuffled or broadcast.

``shared_runs`` lists the pairs that hold ``run`` consecutive words:

1. A first scan counts in how many texts each five-word gram of the items occurs.
2. From each window of ``run`` words of an item that may occur whole the rarest gram is its seed, so
   a text that holds ``run`` consecutive words of an item always holds a seed of it.
3. A second scan looks up the seeds; each stretch of a text around them is aligned with the item
   (Smith-Waterman), and the pairs that score as much as ``run`` equal words go on.

``leaked_passages`` lists every pair whose score reaches a threshold that grows with the item, edited
copies included:

1. An upper bound of the score of each document against every item is kept word by word: two for a
   word the item holds, one off for each word left out and one more where two neighbours of the
   alignment are not as near in the item. It never lies under the score, so no pair is lost, and
   takes a few byte operations a word and item.
2. Pairs whose bound reaches the threshold are aligned, first by score alone on the stretch where
   it may be reached, then whole.

The item side grows with the number of test items alone. It is taken in blocks of about
``BLOCK_CHARS`` characters, each against all texts, so what goes to a task is bounded.

Long texts are split into pieces of ``PIECE_CHARS`` characters while they become word hashes (eight
bytes a word) and of ``PIECE_WORDS`` words, overlapping by what an alignment can span, for the bound.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 5
RUN = 12
#: Items whose bounds are kept side by side, and documents.
ITEM_BLOCK, DOC_BLOCK = 256, 128
#: Characters of items shipped to every task at once (at most as many grams: 16 MB).
BLOCK_CHARS = 2_000_000
PIECE_CHARS, PIECE_WORDS = 1 << 20, 4096
#: Share of an item's words that an edited copy must hold, edits taken off; sentences of one template share half.
MIN_SHARE = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
_FACTOR = 0x9E3779B97F4A7C15
_PACK = 1 << 24
_BITS = 1 << 22
_SEPARATOR, _WORD, _FORMAT = 1, 2, 3


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of unsigned numbers."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * np.uint64(_FACTOR)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Texts to hashes of their words: runs of letters and digits, case folded, format characters off.

    Kind and value of a character are looked up once for each character that occurs. A word's hash is
    the sum of its characters' values, each times a factor of its place.
    """

    def __init__(self):
        self.kind = np.zeros(0x110000, np.uint8)
        self.value = np.zeros(0x110000, np.uint64)
        self.place = _mixed(np.arange(64, dtype=np.uint64)) | np.uint64(1)

    def _learn(self, chars: np.ndarray) -> None:
        for c in np.unique(chars).tolist():
            ch = chr(c)
            category = unicodedata.category(ch)
            self.kind[c] = _FORMAT if category == "Cf" else _WORD if category[0] in "LN" else _SEPARATOR
            low = ch.lower()
            self.value[c] = _mixed(np.array([ord("σ" if low == "ς" else low[0])], np.uint64))[0]

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(texts)
        if "İ" in joined:  # the only character whose small form is two
            texts = [t.replace("İ", "i\u0307") for t in texts]
            joined = "\0".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[chars]
        if not kind.all():
            self._learn(chars[kind == 0])
            kind = self.kind[chars]
        at = np.flatnonzero(kind != _FORMAT) if (kind == _FORMAT).any() else None
        if at is not None:
            chars, kind = chars[at], kind[at]
        inside = np.r_[False, kind == _WORD, False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        sizes = ends - starts
        if sizes.max() > len(self.place):
            self.place = _mixed(np.arange(2 * int(sizes.max()), dtype=np.uint64)) | np.uint64(1)
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        chars = chars[inside[1:-1]]
        with np.errstate(over="ignore"):
            parts = self.value[chars] * self.place[np.arange(len(chars)) - np.repeat(first, sizes)]
            words = _mixed(np.add.reduceat(parts, first)).view(np.int64)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        text_of = np.searchsorted(begins, starts if at is None else at[starts], side="right") - 1
        return words, np.bincount(text_of, minlength=len(texts))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words end to end, and the number of words of each text; a null has none."""
        flat, counts, sizes = [], np.zeros(len(texts), np.int64), 0
        block: list[tuple[int, str]] = []

        def flush() -> None:
            nonlocal block, sizes
            if block:
                words, n = self._block([t for _, t in block])
                flat.append(words)
                np.add.at(counts, [i for i, _ in block], n)
            block, sizes = [], 0

        for i, t in enumerate(texts):
            start = 0
            while t and start < len(t):
                stop = start + PIECE_CHARS
                if stop < len(t):  # between words: at the last blank, else at the next
                    back = t.rfind(" ", start + 1, stop)
                    stop = back if back > 0 else t.find(" ", stop)
                    stop = len(t) if stop < 0 else stop
                block.append((i, t[start:stop]))
                sizes += min(stop, len(t)) - start
                start = stop
                if sizes >= PIECE_CHARS:
                    flush()
        flush()
        return (np.concatenate(flat) if flat else np.zeros(0, np.int64)), counts


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, word hashes and numbers of words of slices of the batches, each of about ``PIECE_CHARS``."""
    hasher = WordHasher()
    for b in batches:
        ids, text = b.column(0), b.column(1)
        bytes_to = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = bytes_to[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(bytes_to, before + PIECE_CHARS, side="right")))
            yield (ids[start:stop], *hasher(text[start:stop].to_pylist()))
            start = stop


def gram_hashes(flat: np.ndarray, sizes: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and position of every n-gram; ``flat`` holds the rows' word hashes end to end."""
    total = len(flat)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = flat.view(np.uint64)
    h = np.zeros(total - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(_FACTOR) + words[j : total - n + 1 + j]
    starts = np.r_[0, np.cumsum(sizes)]
    row = np.repeat(np.arange(len(sizes)), sizes)[: total - n + 1]
    at = np.arange(total - n + 1)
    inside = at + n <= starts[row + 1]
    return h[inside].view(np.int64), row[inside], (at - starts[row])[inside]


def rare_seeds(df_by_gram: np.ndarray, width: int) -> np.ndarray:
    """Positions of the seeds among an item's grams, given how many texts hold each.

    Where a text may hold a whole window of ``width`` grams, that is where all of them occur, the
    window's rarest gram is a seed (ties: the first). Lists shorter than a window are one.
    """
    n = len(df_by_gram)
    if not n:
        return np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(df_by_gram, min(n, width))
    whole = np.flatnonzero(views.min(axis=1) > 0)
    return np.unique(views[whole].argmin(axis=1) + whole).astype(np.int64)


def align_many(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 16) -> list[tuple[int, int, int]]:
    """Local alignment of pairs of word sequences: score, longest run of equal words, equal words on the path.

    Pairs of like size are laid side by side; each step advances all of them by one word of the item.
    Gaps along a document are a running maximum. Score and equal words travel in one number.
    """
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    at = 0
    while at < len(order):
        group, width = [], 1
        while at < len(order) and (not group or (len(group) + 1) * max(width, len(pairs[order[at]][1])) <= cells):
            group.append(order[at])
            width = max(width, len(pairs[order[at]][1]))
            at += 1
        height = max(len(pairs[i][0]) for i in group)
        item = np.zeros((len(group), height), dtype=np.int64)
        doc = np.zeros((len(group), width), dtype=np.int64)
        in_item, in_doc = np.zeros(item.shape, dtype=bool), np.zeros(doc.shape, dtype=bool)
        for k, i in enumerate(group):
            a, b = pairs[i]
            item[k, : len(a)], in_item[k, : len(a)] = a, True
            doc[k, : len(b)], in_doc[k, : len(b)] = b, True
        slope = np.arange(width + 1, dtype=np.int64) * (-GAP * _PACK)
        state = np.zeros((len(group), width + 1), dtype=np.int64)
        run = np.zeros((len(group), width + 1), dtype=np.int32)
        best = np.zeros(len(group), dtype=np.int64)
        longest = np.zeros(len(group), dtype=np.int64)
        rows = np.arange(len(group))
        for j in range(height):
            same = (doc == item[:, j : j + 1]) & in_doc & in_item[:, j : j + 1]
            down = np.zeros_like(state)
            np.maximum(state[:, :-1] + np.where(same, MATCH * _PACK + 1, MISMATCH * _PACK), state[:, 1:] + GAP * _PACK, out=down[:, 1:])
            np.maximum(down, 0, out=down)
            state = np.maximum.accumulate(down + slope, axis=1) - slope
            state[state < _PACK] = 0
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            top = state.argmax(axis=1)
            best = np.maximum(best, state[rows, top])
            longest = np.maximum(longest, run.max(axis=1))
        for k, i in enumerate(group):
            out[i] = (int(best[k] // _PACK), int(longest[k]), int(best[k] % _PACK))
    return out


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    return align_many([(item, doc)])[0]


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted table; the table's length for values it lacks."""
    if not len(table):
        return np.zeros(values.shape, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, len(table))


class ScoreBound:
    """Upper bounds of the alignment score of documents with the items of a block.

    An alignment takes each word of its stretch as equal (``MATCH``, if the item holds the word) or
    not (``GAP``). Where equal words are one or two apart in the document but never that near in the
    item, at least one word of the item is left out besides.
    """

    def __init__(self, items: list[np.ndarray], least: list[int]):
        self.kind, self.never = (np.int8, -100) if max(least) <= 100 else (np.int32, -(1 << 28))
        self.least = np.array(least, self.kind)
        self.vocabulary = np.unique(np.concatenate(items))
        n = len(self.vocabulary)
        self.items = [np.searchsorted(self.vocabulary, it) for it in items]
        self.gain = np.full((n + 1, len(items)), self.never, self.kind)
        for k, ids in enumerate(self.items):
            self.gain[ids, k] = MATCH
        self.near = []
        for apart in (1, 2):
            keys = [(ids[:-g] * (n + 1) + ids[g:], k) for k, ids in enumerate(self.items) for g in range(1, apart + 1) if len(ids) > g]
            known, at = np.unique(np.concatenate([x for x, _ in keys] or [np.zeros(0, np.int64)]), return_inverse=True)
            cost = np.full((len(known) + 1, len(items)), GAP * apart, self.kind)
            cost[at, np.repeat([k for _, k in keys], [len(x) for x, _ in keys]).astype(np.int64)] = GAP * (apart - 1)
            self.near.append((known, cost))

    def reached(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(document, item, first and last place where the bound is met) of the pairs that may score the item's ``least``."""
        n, out = len(self.vocabulary), []
        order = sorted((i for i in range(len(docs)) if len(docs[i])), key=lambda i: -len(docs[i]))
        for start in range(0, len(order), DOC_BLOCK):
            block = order[start : start + DOC_BLOCK]
            lengths = np.array([len(docs[i]) for i in block])
            ids = np.full((lengths[0], len(block)), n)
            for c, i in enumerate(block):
                ids[: len(docs[i]), c] = _find(self.vocabulary, docs[i])
            pairs = []
            for apart, (known, _) in enumerate(self.near, 1):
                at = np.full(ids.shape, len(known))
                at[apart:] = _find(known, ids[:-apart] * (n + 1) + ids[apart:]) if len(ids) > apart else at[apart:]
                pairs.append(at)
            active = np.searchsorted(-lengths, -np.arange(len(ids)), side="left")  # longer than the place
            shape = (len(block), self.gain.shape[1])
            last, before = np.full(shape, self.never, self.kind), np.full(shape, self.never, self.kind)
            apart = np.zeros(shape, self.kind)
            first, final = np.full(shape, -1, np.int32), np.full(shape, -1, np.int32)
            for p in range(len(ids)):
                a = active[p]
                last, before, apart = last[:a], before[:a], apart[:a]
                now = np.take(self.near[0][1], pairs[0][p, :a], axis=0)
                now += last
                np.maximum(now, apart, out=now)
                two = np.take(self.near[1][1], pairs[1][p, :a], axis=0)
                two += before
                np.maximum(now, two, out=now)
                np.maximum(now, 0, out=now)
                now += np.take(self.gain, ids[p, :a], axis=0)
                met = now >= self.least
                if met.any():
                    i, k = np.nonzero(met)
                    first[i, k] = np.where(first[i, k] < 0, p, first[i, k])
                    final[i, k] = p
                    np.minimum(now, self.least, out=now)
                before += GAP  # the word before the last is left out from now on
                np.maximum(apart, before, out=apart)
                np.maximum(apart, 0, out=apart)
                apart += GAP
                last, before = now, last
            i, k = np.nonzero(first >= 0)
            out += zip((block[x] for x in i), k.tolist(), first[i, k].tolist(), final[i, k].tolist())
        return out


def best_scores(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 15) -> np.ndarray:
    """Scores of ``align_many`` alone, in short numbers; the words of either side are not negative."""
    best = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]).bit_length(), len(pairs[i][0]) // 8, len(pairs[i][1])))
    at = 0
    while at < len(order):
        group, width, height = [], 1, 1
        while at < len(order) and (not group or (len(group) + 1) * max(width, len(pairs[order[at]][1])) <= cells):
            group.append(order[at])
            height, width = max(height, len(pairs[order[at]][0])), max(width, len(pairs[order[at]][1]))
            at += 1
        kind = np.int16 if MATCH * height + width < 32_000 else np.int32
        item, doc = np.full((len(group), height), -1, np.int32), np.full((len(group), width), -2, np.int32)
        for k, i in enumerate(group):
            item[k, : len(pairs[i][0])], doc[k, : len(pairs[i][1])] = pairs[i]
        slope = np.arange(width + 1).astype(kind) * kind(-GAP)
        state = np.zeros((len(group), width + 1), kind)
        top = np.zeros_like(state)
        for j in range(height):
            step = (doc == item[:, j : j + 1]).astype(kind)
            step *= kind(MATCH - MISMATCH)
            step += kind(MISMATCH)
            step += state[:, :-1]
            state += kind(GAP)
            np.maximum(state[:, 1:], step, out=state[:, 1:])
            np.maximum(state, 0, out=state)
            state += slope
            np.maximum.accumulate(state, axis=1, out=state)
            state -= slope
            np.maximum(top, state, out=top)
        best[group] = top.max(axis=1)
    return best


_OUT = "doc_id long, item_id long, score int, longest_run int, same_words int, item_words int"


def _rows(found: list[tuple[int, int, int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*found)) if found else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _OUT.split(", ")])


def _best(scored: list[tuple[tuple[int, int], tuple[int, int, int]]]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Of each (text, item) the best score with its equal words, and the longest run, of all its stretches."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for pair, (score, run, same) in scored:
        had = best.get(pair, (0, 0, 0))
        top = max((score, same), (had[0], had[2]))
        best[pair] = (top[0], max(run, had[1]), top[1])
    return best


def _leaked(batches: Iterator[pa.RecordBatch], ids: list[int], items: list[np.ndarray], least: list[int]) -> Iterator[pa.RecordBatch]:
    bounds = [(k, ScoreBound(items[k : k + ITEM_BLOCK], least[k : k + ITEM_BLOCK])) for k in range(0, len(items), ITEM_BLOCK)]
    wanted = np.array(least)
    span = 3 * max(map(len, items))  # a score above 0 takes at most three words of the document for each of the item
    for names, flat, sizes in _texts(batches):
        ends = np.cumsum(sizes)
        pieces = [(d, flat[at : min(at + PIECE_WORDS + span, ends[d])]) for d in range(len(sizes)) for at in range(ends[d] - sizes[d], ends[d], PIECE_WORDS)]
        docs = [w for _, w in pieces]
        hits = []
        for k, bound in bounds:
            met = bound.reached(docs)
            n = len(bound.vocabulary)
            near = [(bound.items[i], _find(bound.vocabulary, docs[d][max(0, lo - 3 * len(bound.items[i])) : hi + 1])) for d, i, lo, hi in met]
            near = [(i, np.where(w == n, -3, w)) for i, w in near]
            enough = best_scores(near) >= wanted[[k + i for _, i, *_ in met]] if met else np.zeros(0, bool)
            hits += [(met[x][0], k + met[x][1]) for x in np.flatnonzero(enough)]
        pairs = sorted({(pieces[d][0], i) for d, i in hits})
        of: dict[int, list[int]] = {}
        for p, (d, _) in enumerate(pieces):
            of.setdefault(d, []).append(p)
        every = [(d, i, p) for d, i in pairs for p in of[d]]  # the longest run may lie elsewhere
        found = align_many([(items[i], docs[p]) for _, i, p in every])
        best = _best([((d, i), f) for (d, i, _), f in zip(every, found)])
        yield _rows([(names[d].as_py(), ids[i], *x, len(items[i])) for (d, i), x in best.items()])


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and word hashes of the items, in blocks of about ``BLOCK_CHARS`` characters (one item at least)."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    slices = -(-total // BLOCK_CHARS)
    for s in range(slices):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s).toArrow()
        if block.num_rows:
            flat, sizes = WordHasher()(block.column("text").to_pylist())
            yield block.column("item_id").to_pylist(), np.split(flat, np.cumsum(sizes)[:-1])


def _corpus(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)


def _union(parts: list[DataFrame], docs: DataFrame) -> DataFrame:
    if not parts:
        return docs.sparkSession.createDataFrame([], _OUT)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def threshold(n_words: int, min_score: int, min_share: float) -> int:
    """Score an item of so many words must reach: that of ``min_share`` of its words, ``min_score`` at least."""
    return max(min_score, math.ceil(MATCH * min_share * n_words))


def leaked_passages(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_score: int = MATCH * RUN, min_share: float = MIN_SHARE
) -> DataFrame:
    """``(doc_id, item_id, score, longest_run, same_words, item_words)`` of all pairs that reach the :func:`threshold` of the item.

    ``min_score`` is above 0. ``longest_run`` is the greatest number of consecutive words both hold,
    ``same_words`` the equal words on the alignment. With ``min_share`` 0 every pair that shares
    ``min_score / MATCH`` consecutive words is found. Null and empty texts and texts too short for the
    score match nothing. Each row is a text of its own, repeated ids too; other columns are ignored.
    """
    if min_score < 1:
        raise ValueError("min_score must be above 0: pairs without a word in common score 0")
    corpus, parts = _corpus(docs, doc_id, text), []
    for ids, texts in item_blocks(items, item_id, text):
        least = [threshold(len(t), min_score, min_share) for t in texts]
        able = [i for i, t in enumerate(texts) if MATCH * len(t) >= least[i]]
        if able:
            block = [ids[i] for i in able], [texts[i] for i in able], [least[i] for i in able]
            parts.append(corpus.mapInArrow(lambda it, block=block: _leaked(it, *block), _OUT))
    return _union(parts, docs)


def _wanted(gram: np.ndarray, wanted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the grams that are in the sorted array; a bit table answers most lookups before the search."""
    at = np.flatnonzero(bits[gram.view(np.uint64) & np.uint64(_BITS - 1)])
    return at[_find(wanted, gram[at]) < len(wanted)]


def _bit_table(wanted: np.ndarray) -> np.ndarray:
    bits = np.zeros(_BITS, dtype=bool)
    bits[wanted.view(np.uint64) & np.uint64(_BITS - 1)] = True
    return bits


def _gram_counts(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(gram, number of texts) of the wanted grams, one row a gram and task."""
    bits, counts = _bit_table(wanted), np.zeros(len(wanted), np.int64)
    for _, flat, sizes in _texts(batches):
        gram, row, _ = gram_hashes(flat, sizes)
        at = _wanted(gram, wanted, bits)
        pair = np.unique(row[at] * len(wanted) + np.searchsorted(wanted, gram[at]))
        counts += np.bincount(pair % len(wanted), minlength=len(wanted))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(wanted[some]), pa.array(counts[some])], names=["gram", "n"])


def _stretches(row: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray, most: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, begin, end): overlapping stretches of a pair united up to ``most`` words; longer chains start anew."""
    out: list[list[int]] = []
    for k in np.lexsort((begin, item, row)).tolist():
        r, i, lo, hi = int(row[k]), int(item[k]), int(begin[k]), int(end[k])
        if out and out[-1][:2] == [r, i] and lo <= out[-1][3] and hi - out[-1][2] <= most[i]:
            out[-1][3] = max(out[-1][3], hi)
        else:
            out.append([r, i, lo, hi])
    return [tuple(x) for x in out]


def _seeded(batches: Iterator[pa.RecordBatch], ids: list[int], items: list[np.ndarray], seeds: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs that hold a seed and score ``least``; ``seeds`` are gram, item and place, sorted by gram."""
    gram_of, item_of, place_of = seeds
    wanted, first, many = np.unique(gram_of, return_index=True, return_counts=True)
    bits = _bit_table(wanted)
    lengths = np.array([len(t) for t in items])
    for names, flat, sizes in _texts(batches):
        gram, row, pos = gram_hashes(flat, sizes)
        at = _wanted(gram, wanted, bits)
        known = np.searchsorted(wanted, gram[at])
        reps = many[known]
        hit = np.repeat(first[known], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        row, pos, item = np.repeat(row[at], reps), np.repeat(pos[at], reps), item_of[hit]
        lead = pos - place_of[hit]  # where the item would begin
        ends = np.cumsum(sizes)
        # the run lies where the item would; half an item more on either side lets the alignment go on over edits
        begin = np.maximum(0, lead - lengths[item] // 2)
        end = np.minimum(sizes[row], lead + lengths[item] + lengths[item] // 2)
        spans = _stretches(row, item, begin, end, 8 * lengths)
        found = align_many([(items[i], flat[ends[r] - sizes[r] + lo : ends[r] - sizes[r] + hi]) for r, i, lo, hi in spans])
        best = _best([((r, i), f) for (r, i, *_), f in zip(spans, found) if f[0] >= least])
        yield _rows([(names[r].as_py(), ids[i], *x, len(items[i])) for (r, i), x in best.items()])


def shared_runs(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = RUN) -> DataFrame:
    """``(doc_id, item_id)`` and the alignment around their seeds, of pairs that share ``run`` consecutive words.

    ``run`` is ``GRAM`` or more. Null and empty texts and texts shorter than ``run`` match nothing. Each
    row is a text of its own, repeated ids too; other columns are ignored.
    """
    if run < GRAM:
        raise ValueError(f"run must be {GRAM} or more")
    corpus, parts = _corpus(docs, doc_id, text), []
    for ids, texts in item_blocks(items, item_id, text):
        flat, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
        gram, item, place = gram_hashes(flat, sizes)
        wanted = np.unique(gram)
        if not len(wanted):
            continue
        counts = corpus.mapInArrow(lambda it, wanted=wanted: _gram_counts(it, wanted), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        df = np.zeros(len(wanted), np.int64)
        df[np.searchsorted(wanted, counts.column("gram").to_numpy())] = counts.column("n").to_numpy()
        df = df[np.searchsorted(wanted, gram)]  # in the order of item and place
        starts = np.r_[0, np.cumsum(np.bincount(item, minlength=len(texts)))]
        pick = np.concatenate([starts[i] + rare_seeds(df[starts[i] : starts[i + 1]], run - GRAM + 1) for i in range(len(texts))])
        pick = pick[np.argsort(gram[pick], kind="stable")]
        if len(pick):
            block = ids, texts, (gram[pick], item[pick], place[pick])
            parts.append(corpus.mapInArrow(lambda it, block=block: _seeded(it, *block, MATCH * run), _OUT))
    return _union(parts, docs).where(F.col("longest_run") >= run)
