"""Texts into containers of fixed token capacity with little unused space.

The plan is made over the histogram of lengths, never over documents: best fit, longest first,
places all texts of one length at once into the open containers of the least sufficient room. Each
planning step covers a run of ranks within a length; a document then finds its slot from its rank
among the documents of its length. Ranks come from counts of (length, bucket) cells and a sort
inside each cell, so no length, however frequent, is sorted in one task.

Size bounds: the histogram has at most ``capacity`` rows. Groups of equal containers split at most
twice a length and are touched at most once for each distinct length in a container, so the plan
has fewer than 3 * capacity * sqrt(2 * capacity) steps whatever the number of documents (a few
thousand in practice); it is shipped to the tasks.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netledger.session import cut

CAPACITY = 2048
#: Texts of one (length, bucket) cell, about.
CELL_ROWS = 500_000
_PIECES = "doc_id long, piece int, n_tokens int, byte_from long, byte_to long"


def vocabulary_path() -> str:
    """Place of the default public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_loaded: dict[tuple[str, str], object] = {}


def tokenizer(path: str, pattern: str):
    """Byte-level BPE from a file of base64 tokens and ranks; kept for the life of a worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        _loaded[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def _pieces(batches: Iterator[pa.RecordBatch], name: str, pattern: str, capacity: int) -> Iterator[pa.RecordBatch]:
    enc = tokenizer(SparkFiles.get(name), pattern)
    for b in batches:
        rows: list[tuple] = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = enc.encode_ordinary(text)
            size = len(text.encode("utf-8", "surrogatepass"))
            if len(ids) <= capacity:
                rows.append((doc, 0, len(ids), 0, size))
                continue
            at = 0
            for k in range(0, len(ids), capacity):
                part = ids[k : k + capacity]
                width = sum(map(len, enc.decode_tokens_bytes(part)))
                rows.append((doc, k // capacity, len(part), at, at + width))
                at += width
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        names = ("doc_id", "piece", "n_tokens", "byte_from", "byte_to")
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=list(names))


def token_pieces(docs: DataFrame, doc_id: str, text: str, *, capacity: int = CAPACITY, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, piece, n_tokens, byte_from, byte_to)``: each text, or its pieces if it exceeds the capacity.

    Pieces are cut after every ``capacity`` tokens; byte offsets are into the UTF-8 text, so pieces
    concatenate to the text. Null texts have no piece; an empty text has one of no tokens. ``vocabulary`` is
    the path of a tokenizer's file as the driver sees it and ``pattern`` what splits texts before it; the file is sent to
    the executors, which need not have it.
    """
    path = vocabulary or vocabulary_path()
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    docs.sparkSession.sparkContext.addFile(path)
    name = path.rstrip("/").rpartition("/")[2]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(lambda it: _pieces(it, name, pattern, capacity), _PIECES)


def plan_containers(counts: dict[int, int], capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """Best fit over a histogram of lengths 1..capacity.

    Returns steps as arrays (length, rank_from, per: texts a container takes, container, offset:
    tokens already in it, position: texts already in it) and the number of containers. A step
    places ranks from ``rank_from`` up to the next step of its length.
    """
    steps: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int, int]]] = {}  # free tokens -> groups (first container, how many, texts in each)
    frees: list[int] = []
    made = 0

    def give(free: int, group: tuple[int, int, int]) -> None:
        if free and group[1]:
            if free not in room:
                room[free] = []
                bisect.insort(frees, free)
            room[free].append(group)

    for length in sorted((n for n, c in counts.items() if n > 0 and c > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(frees, length)
            if i < len(frees):
                free = frees[i]
                first, many, held = room[free].pop()
                if not room[free]:
                    del room[free]
                    frees.pop(i)
            else:
                free, first, held = capacity, made, 0
                many = -(-left // (capacity // length))
                made += many
            per = free // length
            full = min(many, left // per)
            offset = capacity - free
            if full:
                steps.append((length, rank, per, first, offset, held))
                give(free - per * length, (first, full, held + per))
                rank += full * per
                left -= full * per
            if full < many:
                if left and left < per:
                    steps.append((length, rank, per, first + full, offset, held))
                    give(free - left * length, (first + full, 1, held + left))
                    rank += left
                    left = 0
                    full += 1
                give(free, (first + full, many - full, held))
    cols = np.array(steps, dtype=np.int64).reshape(-1, 6)
    order = np.lexsort((cols[:, 1], cols[:, 0]))
    names = ("length", "rank_from", "per", "container", "offset", "position")
    return {n: cols[order, i] for i, n in enumerate(names)}, made


def _place(batches: Iterator[pa.RecordBatch], plan: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    width = np.int64(2**44)
    code = plan["length"] * width + plan["rank_from"]
    for b in batches:
        n = b.column("n_tokens").to_numpy().astype(np.int64)
        rank = b.column("rank").to_numpy().astype(np.int64)
        at = np.searchsorted(code, n * width + rank, side="right") - 1
        some = n > 0
        if not len(code):
            at, some = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=bool)
        if len(code):
            ahead = rank - plan["rank_from"][at]
            container = plan["container"][at] + ahead // plan["per"][at]
            nth = ahead % plan["per"][at]
            position, offset = plan["position"][at] + nth, plan["offset"][at] + nth * n
        else:
            container = position = offset = np.zeros(len(n), dtype=np.int64)
        extra = [pa.array(container, pa.int64(), mask=~some), pa.array(position.astype(np.int32), pa.int32(), mask=~some), pa.array(offset.astype(np.int32), pa.int32(), mask=~some)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "n_tokens", "byte_from", "byte_to")), *extra], names=["doc_id", "piece", "n_tokens", "byte_from", "byte_to", "container", "position", "token_offset"])


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of :func:`token_pieces` with ``container, position, token_offset``.

    Container numbers run from 0; positions count from 0 in each container and token offsets say
    where a text starts in it. Texts without tokens need no room: their container is null. Equal
    lengths, repeated rows and ties are placed in order of hash bucket, document and piece.
    """
    pieces = cut(pieces, "pieces")
    counts = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    if counts and max(counts) > capacity:
        raise ValueError("a piece exceeds the capacity")
    plan, _ = plan_containers(counts, capacity)
    buckets = max(1, -(-max(counts.values(), default=1) // CELL_ROWS))
    cell = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = cell.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("n_tokens", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece"))
    ranked = cell.withColumn("local", local).join(offsets, ["n_tokens", "bucket"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    out = _PIECES + ", container long, position int, token_offset int"
    return ranked.select("doc_id", "piece", "n_tokens", "byte_from", "byte_to", "rank").mapInArrow(lambda it: _place(it, plan), out)
