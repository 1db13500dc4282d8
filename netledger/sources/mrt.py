"""BGP update dumps in MRT format (RFC 6396) to announcements.

Files, plain or packed with gzip or bzip2, are decoded one a task; an hour of updates is some MB. Only
what the announcements need is decoded: BGP4MP messages with two- and four-byte numbers, with and
without microseconds, of type UPDATE.
"""

from __future__ import annotations

import bz2
import gzip
import ipaddress
import itertools
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BGP4MP = {16: 0, 17: 4}  # type -> bytes of microseconds
_MESSAGES = {1: 2, 4: 4, 6: 2, 7: 4}  # subtype -> bytes of a number
_SET, _SEQUENCE, _CONFED_SEQUENCE, _CONFED_SET = 1, 2, 3, 4


def unpack(data: bytes) -> bytes:
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    return bz2.decompress(data) if data[:3] == b"BZh" else data


def _prefixes(data: bytes, version: int) -> Iterator[str]:
    at, size = 0, 4 if version == 1 else 16
    while at < len(data):
        length = data[at]
        used = (length + 7) // 8
        packed = data[at + 1 : at + 1 + used]
        if length > size * 8 or len(packed) < used:
            return
        yield f"{ipaddress.ip_address(packed.ljust(size, bytes(1)))}/{length}"
        at += 1 + used


def _path(data: bytes, width: int) -> list[str]:
    """Hops in order; a set is ``{a,b}``, confederations stand in brackets."""
    hops, at = [], 0
    while at + 2 <= len(data):
        kind, count = data[at], data[at + 1]
        at += 2
        end = at + count * width
        if end > len(data):
            break
        numbers = [str(int.from_bytes(data[i : i + width], "big")) for i in range(at, end, width)]
        at = end
        if kind == _SEQUENCE:
            hops += numbers
        elif kind == _SET:
            hops.append("{" + ",".join(numbers) + "}")
        else:
            hops.append(("({})" if kind == _CONFED_SEQUENCE else "[{}]").format(" ".join(numbers)))
    return hops


def merged_path(path: list[str], path4: list[str]) -> list[str]:
    """Four-byte numbers, where carried apart, stand for the tail of the path (RFC 6793); a longer tail than the path is ignored."""
    return path if len(path4) > len(path) else path[: len(path) - len(path4)] + path4


def _update(body: bytes, width: int) -> Iterator[tuple[str, str]]:
    """(prefix, origin) of the announcements of an UPDATE."""
    gone = int.from_bytes(body[:2], "big")
    at = 2 + gone
    size = int.from_bytes(body[at : at + 2], "big")
    attrs, nlri = body[at + 2 : at + 2 + size], body[at + 2 + size :]
    path: list[str] = []
    path4: list[str] = []
    found = list(_prefixes(nlri, 1))
    at = 0
    while at + 3 <= len(attrs):
        flags, kind = attrs[at], attrs[at + 1]
        wide = 2 if flags & 0x10 else 1
        n = int.from_bytes(attrs[at + 2 : at + 2 + wide], "big")
        value = attrs[at + 2 + wide : at + 2 + wide + n]
        at += 2 + wide + n
        if kind == 2:
            path = _path(value, width)
        elif kind == 17:
            path4 = _path(value, 4)
        elif kind == 14 and len(value) > 5 and value[2] == 1:
            family = int.from_bytes(value[:2], "big")
            found += _prefixes(value[4 + value[3] + 1 :], family)
    origin = merged_path(path, path4)[-1:] or [""]
    for p in found:
        if origin[0]:
            yield p, origin[0]


def announcements(data: bytes) -> Iterator[tuple[int, str, str]]:
    """(epoch second, prefix, origin) of every announcement of a dump; a cut last record is left out."""
    at = 0
    while at + 12 <= len(data):
        second, kind, subtype, size = struct.unpack_from(">IHHI", data, at)
        record = data[at + 12 : at + 12 + size]
        at += 12 + size
        if kind not in _BGP4MP or subtype not in _MESSAGES or len(record) < size:
            continue
        width = _MESSAGES[subtype]
        p = _BGP4MP[kind] + 2 * width + 2
        family = int.from_bytes(record[p : p + 2], "big")
        p += 2 + 2 * (4 if family == 1 else 16)
        message = record[p:]
        if len(message) < 19 or message[18] != 2:
            continue
        length = int.from_bytes(message[16:18], "big")
        for prefix, origin in _update(message[19:length], width):
            yield second, prefix, origin


def encode_update(second: int, prefix: str, origin: str) -> bytes:
    """A BGP4MP record that announces one prefix, its path being 9 and the origin (a number, or a set ``{a,b}``)."""
    net = ipaddress.ip_network(prefix, strict=False)
    nlri = bytes([net.prefixlen]) + net.network_address.packed[: (net.prefixlen + 7) // 8]
    number = lambda x: int(x).to_bytes(4, "big")
    if origin.startswith("{"):
        members = origin.strip("{}").split(",")
        path = bytes([_SEQUENCE, 1]) + number(9) + bytes([_SET, len(members)]) + b"".join(map(number, members))
    else:
        path = bytes([_SEQUENCE, 2]) + number(9) + number(origin)
    attrs = bytes([0x50, 2]) + len(path).to_bytes(2, "big") + path
    if net.version == 6:
        reach = b"\0\2\1\x10" + bytes(16) + b"\0" + nlri
        attrs += bytes([0x50, 14]) + len(reach).to_bytes(2, "big") + reach
        nlri = b""
    body = b"\0\0" + len(attrs).to_bytes(2, "big") + attrs + nlri
    message = b"\xff" * 16 + struct.pack(">HB", 19 + len(body), 2) + body
    record = number(9) * 2 + b"\0\0\0\1" + bytes(8) + message
    return struct.pack(">IHHI", second, 16, 4, len(record)) + record


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
            found = announcements(unpack(content))
            while part := list(itertools.islice(found, 50_000)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(part)),
                        pa.array([int(datetime.fromtimestamp(s, UTC).strftime("%Y%m%d")) for s, _, _ in part], pa.int32()),
                        pa.array([p for _, p, _ in part]),
                        pa.array([o for _, _, o in part]),
                    ],
                    names=["path", "date", "prefix", "origin"],
                )


def vantage_point(path: str) -> Column:
    """The folder of a collector in an archive's path, above folders of months and ``UPDATES``."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    named = F.filter(parts, lambda x: ~F.upper(x).isin("UPDATES", "BGPDATA") & ~x.rlike(r"^\d{4}[.-]?\d{2}([.-]?\d{2})?$"))
    return F.element_at(named, -1)


def read_updates(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``vantage, date, prefix, origin``, distinct within each vantage point and day, whatever the number of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    rows = files.mapInArrow(_decode, "path string, date int, prefix string, origin string")
    return rows.select(vantage_point("path").alias("vantage"), "date", "prefix", "origin").distinct()
