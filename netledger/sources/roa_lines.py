"""Raw ROA export lines to typed rows, with broken lines kept apart and explained.

Lines are tokenized by a finite-state machine over bytes that knows about quotes. A batch of lines
is laid out as fixed-width chunks, whatever the lengths of the lines. Pass one runs every chunk
from every state at once, giving its transition function; composing these along a line tells the
state in which each chunk starts. Pass two runs each chunk from its true state and marks
separators and quoting errors by byte offset. Both passes are numpy operations over all chunks.

Field checks look at each distinct value of a batch once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 128

# states of the tokenizer
START, PLAIN, QUOTED, CLOSED, BROKEN, PLAIN_BLANK = range(6)
# classes of bytes
OTHER, QUOTE, COMMA, BLANK, END = range(5)
#: next state by (state, class). END pads the chunk behind the line and changes nothing.
STEP = np.array(
    [
        # OTHER   QUOTE    COMMA   BLANK        END
        [PLAIN, QUOTED, START, PLAIN_BLANK, START],  # START: at a value's first byte
        [PLAIN, BROKEN, START, PLAIN, PLAIN],  # PLAIN
        [QUOTED, CLOSED, QUOTED, QUOTED, QUOTED],  # QUOTED
        [BROKEN, QUOTED, START, BROKEN, CLOSED],  # CLOSED: a quote that ends the value or doubles itself
        [BROKEN, BROKEN, BROKEN, BROKEN, BROKEN],  # BROKEN
        [PLAIN, BROKEN, START, PLAIN_BLANK, PLAIN_BLANK],  # PLAIN_BLANK: only blanks so far
    ],
    dtype=np.uint8,
)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord('"')], _CLASS[ord(",")] = QUOTE, COMMA
_CLASS[[ord(" "), ord("\t")]] = BLANK

FIELDS = ("uri", "asn", "prefix", "max_len", "not_before", "not_after")
ROW_SCHEMA = (
    "line_id long, reason string, error_offset int, uri string, origin long, prefix_addr string, "
    "prefix_len int, max_len int, not_before string, not_after string"
)


def run_machine(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokenize lines lying in one byte buffer.

    Returns the global byte positions of separators, the first position at which each line breaks
    (-1 if it doesn't) and each line's final state.
    """
    n = len(starts)
    per_line = np.maximum(1, -(-sizes // chunk))
    first = np.r_[0, np.cumsum(per_line)]
    total = int(first[-1])
    line = np.repeat(np.arange(n), per_line)
    rank = np.arange(total) - first[line]
    begin = starts[line] + rank * chunk
    width = np.minimum(chunk, sizes[line] - rank * chunk)
    column = np.arange(chunk)
    classes = np.full((total, chunk), END, dtype=np.uint8)
    inside = column[None, :] < width[:, None]
    where = begin[:, None] + column[None, :]
    classes[inside] = _CLASS[data[where[inside]]]

    states = len(STEP)
    flat = STEP.ravel()
    # only chunks that other chunks follow need their transition function
    follows = np.flatnonzero(rank < per_line[line] - 1)
    entry = np.full(total, START, dtype=np.uint8)
    if len(follows):
        reach = np.tile(np.arange(states, dtype=np.uint8), (len(follows), 1))
        for j in range(chunk):
            reach = flat[reach * 5 + classes[follows, j][:, None]]
        function = np.zeros((total, states), dtype=np.uint8)
        function[follows] = reach
        # compose along each line by doubling: function[i] becomes that of chunks 0..i of its line
        step = 1
        while step < per_line.max():
            has = np.flatnonzero((rank >= step) & (rank < per_line[line] - 1))
            function[has] = np.take_along_axis(function[has], function[has - step], axis=1)
            step *= 2
        later = np.flatnonzero(rank > 0)
        entry[later] = function[later - 1, START]

    state = entry.copy()
    after = np.empty((total, chunk), dtype=np.uint8)
    for j in range(chunk):
        state = flat[state * 5 + classes[:, j]]
        after[:, j] = state
    comma = (classes == COMMA) & (after == START)
    separators = where[comma]
    broken = after == BROKEN
    chunk_bad = broken.any(axis=1)
    bad_at = np.full(n, -1, dtype=np.int64)
    rows = np.flatnonzero(chunk_bad)[::-1]
    bad_at[line[rows]] = rank[rows] * chunk + broken[rows].argmax(axis=1)
    return separators, bad_at, state[first[1:] - 1]


_ASN = re.compile(r"(?:AS)?(?:(\d{1,})|(\d+)\.(\d+))", re.I | re.A)
_V4 = re.compile(r"(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})", re.A)
_HEXTET = re.compile(r"[0-9A-Fa-f]{1,4}")
_DIGITS = re.compile(r"\d+", re.A)


def parse_origin(text: str) -> int | None:
    m = _ASN.fullmatch(text)
    if not m:
        return None
    if m[1] is not None:
        value = int(m[1]) if len(m[1].lstrip("0")) <= 10 else 2**32
        return value if value < 2**32 else None
    if len(m[2].lstrip("0")) > 5 or len(m[3].lstrip("0")) > 5 or max(int(m[2]), int(m[3])) > 65535:
        return None
    return int(m[2]) * 65536 + int(m[3])


def _v6_bits(text: str) -> int | None:
    head, gap, tail = text.partition("::")
    if "::" in tail or (gap and (tail.startswith(":") or head.endswith(":"))):
        return None
    left, right = (head.split(":") if head else []), (tail.split(":") if tail else [])
    last = right or left
    if last and "." in last[-1]:  # the low 32 bits as a dotted quad
        low = _v4_bits(last.pop())
        if low is None:
            return None
        last += [f"{low >> 16:x}", f"{low & 65535:x}"]
    if not all(_HEXTET.fullmatch(x) for x in left + right):
        return None
    missing = 8 - len(left) - len(right)
    if (missing < 1) if gap else (missing != 0):
        return None
    value = 0
    for x in left + ["0"] * (missing if gap else 0) + right:
        value = value * 65536 + int(x, 16)
    return value


def _v4_bits(text: str) -> int | None:
    m = _V4.fullmatch(text)
    if not m or any(int(x) > 255 for x in m.groups()):
        return None
    return int(m[1]) << 24 | int(m[2]) << 16 | int(m[3]) << 8 | int(m[4])


def parse_prefix(text: str) -> tuple[str, int, int] | None:
    """Address, length and width in bits; None if malformed or bits are set beyond the length."""
    addr, slash, length = text.partition("/")
    if not slash or not _DIGITS.fullmatch(length) or len(length.lstrip("0")) > 3:
        return None
    width = 128 if ":" in addr else 32
    bits = _v6_bits(addr) if width == 128 else _v4_bits(addr)
    n = int(length)
    if bits is None or n > width or bits & ((1 << (width - n)) - 1):
        return None
    return addr, n, width


def _blank(line: str) -> bool:
    return not line.strip() or line.startswith(("#", "%", "URI,"))


def _value(raw: str) -> str:
    """A token as its value: quotes off and undoubled, blanks around unquoted values off."""
    return raw[1:-1].replace('""', '"') if raw[:1] == '"' else raw.strip(" \t")


def parse_batch(line_ids: list, lines: list[str | None], chunk: int = CHUNK) -> list[tuple]:
    """Rows of ``ROW_SCHEMA`` for the lines that are rows; ``reason`` is null for sound ones."""
    keep = [i for i, x in enumerate(lines) if x is not None and not _blank(x)]
    if not keep:
        return []
    texts = [lines[i].rstrip("\r\n") for i in keep]
    coded = [x.encode("utf-8", "surrogatepass") for x in texts]
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    data = np.frombuffer(b"".join(coded) or b"\0", dtype=np.uint8)
    commas, bad_at, final = run_machine(data, starts, sizes, chunk)
    order = np.sort(commas)
    lo = np.searchsorted(order, starts)
    hi = np.searchsorted(order, starts + sizes)
    origins: dict[str, int | None] = {}
    prefixes: dict[str, tuple | None] = {}
    out = []
    for k, i in enumerate(keep):
        none = (None,) * 7
        if bad_at[k] >= 0 or final[k] == QUOTED:
            out.append((line_ids[i], "quoting", int(bad_at[k]) if bad_at[k] >= 0 else int(sizes[k]), *none))
            continue
        cuts = (order[lo[k] : hi[k]] - starts[k]).tolist()
        edges = [-1, *cuts, int(sizes[k])]
        if len(cuts) != 5:
            out.append((line_ids[i], "column_count", edges[min(6, len(edges) - 1)], *none))
            continue
        raw = coded[k]
        uri, asn, prefix, max_len, since, until = (
            _value(raw[edges[f] + 1 : edges[f + 1]].decode("utf-8", "surrogatepass")) for f in range(6)
        )
        if asn not in origins:
            origins[asn] = parse_origin(asn)
        if origins[asn] is None:
            out.append((line_ids[i], "origin", edges[1] + 1, *none))
            continue
        if prefix not in prefixes:
            prefixes[prefix] = parse_prefix(prefix)
        p = prefixes[prefix]
        if p is None:
            out.append((line_ids[i], "prefix", edges[2] + 1, *none))
            continue
        longest = None
        if max_len not in ("", "None"):
            if not _DIGITS.fullmatch(max_len) or len(max_len.lstrip("0")) > 3 or not p[1] <= int(max_len) <= p[2]:
                out.append((line_ids[i], "max_len", edges[3] + 1, *none))
                continue
            longest = int(max_len)
        out.append((line_ids[i], None, None, uri, origins[asn], p[0], p[1], longest, since, until))
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("line_id", pa.int64()), ("reason", pa.string()), ("error_offset", pa.int32()), ("uri", pa.string()), ("origin", pa.int64())]
        + [("prefix_addr", pa.string()), ("prefix_len", pa.int32()), ("max_len", pa.int32()), ("not_before", pa.string()), ("not_after", pa.string())]
    )
    for b in batches:
        rows = parse_batch(b.column(0).to_pylist(), b.column(1).to_pylist())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def parse_roa_lines(df: DataFrame, line_id: str = "line_id", raw_line: str = "raw_line") -> DataFrame:
    """Typed rows and failures of raw lines, in one table (``ROW_SCHEMA``).

    Sound lines have a null ``reason``; broken ones have the first reason that applies (quoting,
    column_count, origin, prefix, max_len) and the byte offset at which it shows. Null, blank,
    comment and header lines are neither. Lines may be of any length; repeated lines stay. One
    narrow stage, no shuffle.
    """
    return df.select(F.col(line_id).cast("long").alias("line_id"), F.col(raw_line).cast("string").alias("raw_line")).where(
        F.col("raw_line").isNotNull()
    ).mapInArrow(_parse, ROW_SCHEMA)
