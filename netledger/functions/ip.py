"""Addresses and prefixes as integers.

A network is ``net``, a struct ``(fam, hi, lo)``: family 4 or 6 and the 128 address bits as two
signed longs, an IPv4 address left-aligned in ``hi``. Masking, grouping and equi-joins then read the same
for both families. Numbers of delegations, which only IPv4 counts one by one, are a single BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_QUAD = r"^[0-9]{1,3}([.][0-9]{1,3}){3}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ipv4_to_long(addr) -> Column:
    """Dotted quad to 0..2^32-1; null if it is not four decimal octets.

    Without lambdas, so that it compiles and its common parts are computed once a row.
    """
    c = _c(addr)
    octets = [F.split_part(c, F.lit("."), F.lit(i)).try_cast("long") for i in (1, 2, 3, 4)]
    value, good = octets[0], c.rlike(_QUAD)
    for o in octets[1:]:
        value = value * 256 + o
    for o in octets:
        good &= o <= 255
    return F.when(good, value)


def long_to_ipv4(net) -> Column:
    n = _c(net)
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def net4(n) -> Column:
    """The network of an IPv4 address held as BIGINT."""
    return F.struct(F.lit(4).alias("fam"), F.call_function("shiftleft", _c(n), F.lit(32)).alias("hi"), F.lit(0).cast("long").alias("lo"))


def net_hex(net) -> Column:
    """The address bits of a network as 8 (IPv4) or 32 (IPv6) hexadecimal digits."""
    n = _c(net)
    hi, lo = F.lpad(F.hex(n["hi"]), 16, "0"), F.lpad(F.hex(n["lo"]), 16, "0")
    return F.lower(F.when(n["fam"] == 4, F.substr(hi, F.lit(1), F.lit(8))).otherwise(F.concat(hi, lo)))


def long_to_ipv6(hi, lo) -> Column:
    """Canonical text: lower case, no leading zeros, the first of the longest runs of zero groups as ``::``."""
    group = lambda n, s: F.lower(F.hex(F.call_function("shiftrightunsigned", _c(n), F.lit(s)).bitwiseAND(F.lit(0xFFFF).cast("long"))))
    text = F.concat(F.lit(":"), F.concat_ws(":", *(group(n, s) for n in (hi, lo) for s in (48, 32, 16, 0))), F.lit(":"))
    out = F.substr(text, F.lit(2), F.length(text) - 2)
    for k in range(2, 9):
        zeros = ":0" * k + ":"
        at = F.instr(text, zeros)
        short = F.concat(F.substr(text, F.lit(2), F.greatest(F.lit(0), at - 2)), F.lit("::"), F.substr(text, at + len(zeros), F.greatest(F.lit(0), F.length(text) - at - len(zeros))))
        out = F.when(at > 0, short).otherwise(out)
    return out


def address_text(net) -> Column:
    n = _c(net)
    return F.when(n["fam"] == 4, long_to_ipv4(F.call_function("shiftrightunsigned", n["hi"], F.lit(32)))).otherwise(long_to_ipv6(n["hi"], n["lo"]))


def prefix_text(net, length) -> Column:
    """``addr/len`` of a network."""
    return F.concat_ws("/", address_text(net), _c(length).cast("string"))


def mask4(net, length) -> Column:
    """Clear the host bits of an IPv4 address held as BIGINT."""
    gap = F.lit(32) - _c(length)
    return F.call_function("shiftleft", F.call_function("shiftright", _c(net), gap), gap)


def num_addresses(length) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - _c(length))


def bit_text(net, length) -> Column:
    """First ``length`` bits of a network as text."""
    n = _c(net)
    return F.substr(F.concat(F.lpad(F.bin(n["hi"]), 64, "0"), F.lpad(F.bin(n["lo"]), 64, "0")), F.lit(1), _c(length))


def common_prefix_len(a, b) -> Column:
    """Length of the common prefix of two IPv4 addresses; 32 when equal."""
    x = _c(a).bitwiseXOR(_c(b))
    return F.when(x == 0, F.lit(32)).otherwise(F.lit(32) - F.length(F.bin(x))).cast("int")


def asn_to_long(text) -> Column:
    """``AS64500``, ``64500`` or asdot ``1.5`` to a number; null otherwise."""
    t = F.regexp_replace(F.trim(_c(text)), "^(?i)AS", "")
    dotted = F.split(t, "[.]")
    asdot = F.get(dotted, F.lit(0)).try_cast("long") * 65536 + F.get(dotted, F.lit(1)).try_cast("long")
    return F.when(t.rlike(r"^\d+$"), t.try_cast("long")).when(t.rlike(r"^\d+[.]\d+$"), asdot)


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Add ``fam, hi, lo, len`` of an ``addr/len`` column of either family; rows that are no prefix go.

    Host bits are kept; use :func:`mask_bits` to clear them. What is no prefix makes an empty list, so no
    filter is pushed below the parsing to do it a second time; IPv4 takes no lambdas.
    """
    colons = "(length(_addr) - length(replace(_addr, ':', '')))"
    groups = f"split(replace(_addr, '::', concat(':', repeat('0:', 8 - {colons}))), ':')"
    one = r"_addr rlike '^([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?(::)?([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?$'"
    staged = df.withColumns({"_addr": F.split_part(F.col(prefix), F.lit("/"), F.lit(1)), "len": F.split_part(F.col(prefix), F.lit("/"), F.lit(2)).try_cast("int")})
    staged = staged.withColumn("_v4", ipv4_to_long("_addr")).withColumn("_g", F.expr(f"CASE WHEN contains(_addr, ':') AND {one} THEN {groups} END"))
    half = lambda k: F.conv(F.concat(*(F.lpad(F.get("_g", F.lit(i)), 4, "0") for i in range(k, k + 4))), 16, -10).cast("long")
    bits = lambda fam, hi, lo: F.array(F.struct(F.lit(fam).alias("fam"), hi.alias("hi"), lo.alias("lo")))
    four = bits(4, F.call_function("shiftleft", F.col("_v4"), F.lit(32)), F.lit(0).cast("long"))
    found = F.when(F.col("_v4").isNotNull() & F.col("len").between(0, 32), four).when((F.size("_g") == 8) & F.col("len").between(0, 128), bits(6, half(0), half(4)))
    return staged.select(*[c for c in df.columns if c not in ("fam", "hi", "lo", "len")], "len", F.inline(found))


def with_net(df: DataFrame, prefix: str) -> DataFrame:
    """Add ``net`` and ``len`` of an ``addr/len`` column of either family; rows that are no prefix go."""
    other = [c for c in df.columns if c not in ("net", "len")]
    return with_prefix(df.select(*other), prefix).select(*other, F.struct("fam", "hi", "lo").alias("net"), "len")


def mask_bits(hi, lo, length) -> tuple[Column, Column]:
    """``(hi, lo)`` with every bit beyond ``length`` (1..128) cleared."""
    h, l, n = _c(hi), _c(lo), _c(length)
    ones = F.lit(-1).cast("long")
    hi_mask = F.when(n >= 64, ones).otherwise(F.call_function("shiftleft", ones, F.lit(64) - n))
    lo_mask = F.when(n <= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", ones, F.lit(128) - n))
    return h.bitwiseAND(hi_mask), l.bitwiseAND(lo_mask)
