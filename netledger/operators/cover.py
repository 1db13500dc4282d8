"""Prefix containment as an equi-join.

A probe prefix is contained in a dimension prefix iff masking the probe to the dimension's length
gives the dimension's network. So each probe is spread over the lengths of its family that occur in the
dimension (at most 33 for IPv4 and 129 for IPv6, hence always broadcastable) and joined on
the masked network. Spark then plans a hash join; there is no range predicate. Both families go
through the one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netledger.functions.ip import mask_bits

#: Dimension prefixes up to this number are broadcast, some 10 MB.
SMALL_DIM = 100_000


def cover_join(probe: DataFrame, dim: DataFrame, on: Sequence[str] = (), *, how: str = "inner", distinct: bool = True, default_route: bool = False, measured: bool = False) -> DataFrame:
    """Probes ``(net, len, ...)`` with every dimension prefix of their family that contains them.

    Dimension columns other than ``on`` come out prefixed ``c_``. Prefixes of length 0 match nothing, or
    with ``default_route`` all of their family, and repeated dimension rows count once (``distinct``).
    ``how`` is ``inner`` or ``left``. Null networks or lengths never match. ``measured`` counts the
    dimension first and broadcasts it if it has at most ``SMALL_DIM`` rows.
    """
    if distinct:
        dim = dim.distinct()
    dim = dim.where((F.col("len") >= (0 if default_route else 1)) & F.col("net").isNotNull())
    lens = dim.select(F.col("net.fam").alias("_fam"), F.col("len").alias("_clen")).distinct()
    d = dim.select(*[F.col(c).alias(f"_on_{c}" if c in on else f"c_{c}") for c in dim.columns])
    none = F.lit(0).cast("long")
    clear = lambda net, n: [F.when(F.col(n) == 0, none).otherwise(x) for x in mask_bits(F.col(f"{net}.hi"), F.col(f"{net}.lo"), n)]
    hi, lo = clear("c_net", "c_len")
    d = d.withColumns({"_dfam": F.col("c_net.fam"), "_dhi": hi, "_dlo": lo})
    if measured and dim.limit(SMALL_DIM + 1).count() <= SMALL_DIM:
        d = F.broadcast(d)
    spread = probe.join(F.broadcast(lens), (F.col("net.fam") == F.col("_fam")) & (F.col("_clen") <= F.col("len")), "inner")
    hi, lo = clear("net", "_clen")
    spread = spread.withColumns({"_hi": hi, "_lo": lo})
    cond: Column = (F.col("_hi") == F.col("_dhi")) & (F.col("_lo") == F.col("_dlo")) & (F.col("_clen") == F.col("c_len")) & (F.col("_fam") == F.col("_dfam"))
    for c in on:
        cond &= F.col(c) == F.col(f"_on_{c}")
    hits = spread.join(d, cond, "inner").drop("_fam", "_hi", "_lo", "_clen", "_dfam", "_dhi", "_dlo", *[f"_on_{c}" for c in on])
    if how == "inner":
        return hits
    ids = probe.columns
    found = hits.select(*[F.col(c).alias(f"_f_{c}") for c in ids], *[c for c in hits.columns if c not in ids])
    return probe.join(found, [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in ids], "left").drop(*[f"_f_{c}" for c in ids])
