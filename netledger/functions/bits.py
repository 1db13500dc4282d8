"""Bit vectors: text with bit 0 rightmost, a BIGINT, or lists of words with bit 0 in the first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_text(text) -> Column:
    """A text of up to 63 binary digits as BIGINT."""
    return F.conv(F.col(text) if isinstance(text, str) else text, 2, 10).cast("long")


def words(bits, size: int, count: int) -> Column:
    """The first ``count`` words of ``size`` bits, separated by ``|``."""
    b = F.col(bits) if isinstance(bits, str) else bits
    mask = F.lit((1 << size) - 1).cast("long")
    return F.concat_ws("|", *(F.call_function("shiftrightunsigned", b, F.lit(size * i)).bitwiseAND(mask).cast("string") for i in range(count)))


def from_words(text, size: int) -> Column:
    """Words separated by ``|`` as one BIGINT (63 bits at most)."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, "[|]")
    return F.aggregate(F.reverse(parts), F.lit(0).cast("long"), lambda acc, w: F.call_function("shiftleft", acc, F.lit(size)) + w.cast("long"))


def shifted(bits, by: int, size, fill: int = 0) -> Column:
    """Every bit ``by`` places later in a vector of ``size`` bits; the first ones are ``fill``."""
    b = F.col(bits) if isinstance(bits, str) else bits
    one = F.lit(1).cast("long")
    ones = F.call_function("shiftleft", one, size) - 1
    out = F.call_function("shiftleft", b, F.lit(by)).bitwiseAND(ones)
    return out.bitwiseOR(F.lit((1 << by) - 1).cast("long").bitwiseAND(ones)) if fill else out
