"""Scores of a two-headed classifier: probabilities, rejection, precision and recall, methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax1(s0, s1) -> Column:
    """Second component of the softmax of two scores, stable for large scores."""
    x = (F.col(s1) if isinstance(s1, str) else s1) - (F.col(s0) if isinstance(s0, str) else s0)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def rejection_loss(label, s0, s1, cost: float) -> Column:
    """Mean of both heads' losses at one row: each head's own share of the cost, the rest from the other head."""
    t, a, b = F.col(label), F.col(s0), F.col(s1)
    keep = lambda z: (1 - t) * softplus(-z) + t * softplus(z)
    take = lambda z: t * softplus(-z) + (1 - t) * softplus(z)
    first = cost * keep(a) + (1 - cost) * keep(-b)
    second = cost * take(b) + (1 - cost) * take(-a)
    return (first + second) / 2


def y_true(validation) -> Column:
    c = F.col(validation) if isinstance(validation, str) else validation
    return F.when(c == "valid", 1).when(c == "invalid", 0).otherwise(-1)


def y_pred(record_type, s0, s1) -> Column:
    c = F.col(record_type) if isinstance(record_type, str) else record_type
    return F.when(c == "inactive", 0.0).when(c == "excluded", 1.0).otherwise(softmax1(s0, s1))


def kept(s0, s1) -> Column:
    """Not rejected: the scores disagree in sign and one of them is positive."""
    a, b = F.col(s0), F.col(s1)
    return (a * b <= 0) & (F.greatest(a, b) > 0)


def pr_curve(df: DataFrame, label: str, score: str, cells: int = 1024) -> DataFrame:
    """``threshold, precision, recall, f1`` at every distinct score, with ``tp, k, pos, p, n``.

    ``tp`` of the ``k`` rows at or above the threshold are positive, of ``pos`` in all; ``p`` of the ``n``
    rows at it are. Counts per distinct score are summed first; running totals go within ``cells`` equal
    ranges of scores, offset by the totals of the ranges above, so no task orders all scores. Rows with
    a null score or label are left out; without a positive label recall is null.
    """
    steps = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")
    )
    ends = steps.agg(F.struct(F.min("threshold").alias("lo"), F.max("threshold").alias("hi"))).scalar()
    place = F.floor(F.coalesce(F.try_divide(F.col("threshold") - F.col("_ends.lo"), F.col("_ends.hi") - F.col("_ends.lo")), F.lit(0.0)) * (cells - 1))
    placed = steps.withColumn("_ends", ends).withColumn("_cell", place).drop("_ends")
    sums = placed.groupBy("_cell").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))  # one row a cell
    above = Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_cell", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"), F.sum("_p").over(Window.partitionBy(F.lit(0))).alias("pos"))
    down = Window.partitionBy("_cell").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumns({"tp": F.sum("p").over(down), "k": F.sum("n").over(down)}).join(F.broadcast(base), "_cell")
    run = run.withColumns({"tp": F.col("tp") + F.col("_p0"), "k": F.col("k") + F.col("_n0")})
    precision, recall = F.col("tp") / F.col("k"), F.try_divide(F.col("tp"), F.col("pos"))
    f1 = F.try_divide(2 * F.col("tp"), F.col("k") + F.col("pos"))
    return run.select("threshold", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "tp", "k", "pos", "p", "n")


def auc_pr(curve: DataFrame) -> DataFrame:
    """Area under a :func:`pr_curve` by trapezoids, from recall 0 at precision 1.

    The point before a threshold is its totals less its own counts, so the area is a plain sum.
    """
    before_tp, before_k = F.col("tp") - F.col("p"), F.col("k") - F.col("n")
    before = F.coalesce(F.try_divide(before_tp, before_k), F.lit(1.0))
    area = F.try_divide(F.col("p"), F.col("pos")) * (F.col("precision") + before) / 2
    return curve.agg(F.sum(area).alias("auc_pr"))
