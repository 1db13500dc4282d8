"""Training, tuning and applying the model that scores route objects.

One margin m serves both heads: score0 = -m and score1 = m. With the rejection loss the two heads stay
mirror images from a common start, so a second head would carry no information.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netledger.operators.scoring import auc_pr, pr_curve

SEED = 940124
CELLS = 256


def _rank_in_label(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Add ``_rank`` (from 0) of each row within its label by hash of the key, and ``_size`` of the label.

    Rows are ranked within ``CELLS`` ranges of the hash and offset by the ranges before, so no label is sorted
    in one task. The same key always has the same place among the same rows.
    """
    placed = df.withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_cell", F.pmod("_h", F.lit(CELLS)))
    sizes = placed.groupBy(F.col(label).alias("_l"), F.col("_cell").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))  # CELLS rows a label
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_l").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumns({"_before": before, "_size": F.sum("_n").over(Window.partitionBy("_l"))}).drop("_n")
    inner = F.row_number().over(Window.partitionBy(label, "_cell").orderBy("_h", key)) - 1
    ranked = placed.withColumn("_inner", inner).join(offsets, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_cell") == F.col("_c")))
    return ranked.withColumn("_rank", F.col("_before") + F.col("_inner")).drop("_h", "_cell", "_l", "_c", "_before", "_inner")


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.8, seed: int = SEED) -> DataFrame:
    """Add ``part``: ``share`` of each label, rounded down, trains, the rest tests; picked by hash of the key."""
    ranked = _rank_in_label(df, key, label, seed)
    return ranked.withColumn("part", F.when(F.col("_rank") < F.floor(F.col("_size") * share), "train").otherwise("test")).drop("_rank", "_size")


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Add ``fold`` 0..k-1; the folds of a label differ by one row at most."""
    ranked = _rank_in_label(df, key, label, seed)
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_size")


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep").transform(df.na.fill(0.0, list(features)))


def train(df: DataFrame, features: Sequence[str], label: str = "label", *, depth: int = 5, rounds: int = 20, rate: float = 0.1, cost: float = 0.5) -> GBTClassificationModel:
    """Boosted trees on labels 0 and 1; other labels are left out.

    ``cost`` is the rejection cost: the share of each head's own loss. With one margin for both heads the gradient is the
    log loss's times the shares, ``cost`` for one label and ``1 - cost`` for the other, so it enters as weights.
    """
    if not 0 < cost < 1:
        raise ValueError("cost must lie between 0 and 1")
    rows = _vectors(df.where(F.col(label).isin(0, 1)), features).withColumn("_w", F.when(F.col(label) == 1, 2 * (1 - cost)).otherwise(2 * cost))
    return GBTClassifier(labelCol=label, featuresCol="_x", weightCol="_w", maxDepth=depth, maxIter=rounds, stepSize=rate, seed=SEED).fit(rows)


def save(model: GBTClassificationModel, root: str, day: int) -> str:
    """Write the month's model over an older one; its path."""
    model.write().overwrite().save(path := model_path(root, day))
    return path


def load(root: str, day: int) -> GBTClassificationModel:
    return GBTClassificationModel.load(model_path(root, day))


def apply_by_day(df: DataFrame, features: Sequence[str], root: str, day: str = "date", label: str = "label", **params) -> DataFrame:
    """Scores of every day's records by the model of its month, trained on the month's first day and saved.

    The days of a month are scored together. Months whose first day has only one label give no scores.
    """
    months = [(r.date, r.date // 100) for r in latest_per_month(df.select(F.col(day).alias("date"))).where("trains").orderBy("date").collect()]
    out = None
    for first, month in months:
        rows = df.where(F.col(day) == first)
        if rows.where(F.col(label).isin(0, 1)).select(label).distinct().count() < 2:
            continue
        save(train(rows, features, label, **params), root, first)
        scored = apply(load(root, first), df.where(F.expr(f"{day} div 100") == month), features)
        out = scored if out is None else out.unionByName(scored)
    return df.limit(0).withColumns({"score0": F.lit(0.0), "score1": F.lit(0.0)}) if out is None else out


def evaluate(df: DataFrame, features: Sequence[str], key: str, label: str = "label", times: int = 10, **params) -> DataFrame:
    """``run, auc_pr`` of repeated splits by label, each with its own seed, and ``run`` -1 with their mean."""
    areas = []
    for i in range(times):
        s = stratified_split(df.where(F.col(label).isin(0, 1)), key, label, seed=SEED + i)
        scored = apply(train(s.where("part = 'train'"), features, label, **params), s.where("part = 'test'"), features)
        areas.append(auc_pr(pr_curve(scored, label, "score1")).first()[0] or 0.0)
    rows = [(i, float(a)) for i, a in enumerate(areas)] + [(-1, sum(areas) / max(1, times))]
    return df.sparkSession.createDataFrame(rows, "run int, auc_pr double")


def random_search(df: DataFrame, features: Sequence[str], key: str, bounds: dict[str, tuple[float, float]], tries: int = 10, label: str = "label", k: int = 3) -> tuple[dict, float]:
    """The best of ``tries`` points drawn evenly between the bounds (whole numbers stay whole), always the same ones."""
    rng = random.Random(SEED)
    draw = lambda lo, hi: rng.randint(lo, hi) if isinstance(lo, int) and isinstance(hi, int) else rng.uniform(lo, hi)
    return tune(df, features, key, [{name: draw(*b) for name, b in sorted(bounds.items())} for _ in range(tries)], label, k)


def apply(model: GBTClassificationModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``score0`` and ``score1``, the negative and the positive margin."""
    raw = vector_to_array(F.col("rawPrediction"))
    out = model.transform(_vectors(df, features)).withColumn("_m", F.get(raw, F.lit(1)))
    return out.withColumns({"score0": -F.col("_m"), "score1": F.col("_m")}).drop("_x", "_m", "rawPrediction", "probability", "prediction")


def cross_validated(df: DataFrame, features: Sequence[str], key: str, label: str = "label", k: int = 3, **params) -> float:
    """Mean area under the precision-recall curve over folds left out of training."""
    f = folds(df, key, label, k)
    areas = []
    for i in range(k):
        model = train(f.where(F.col("fold") != i), features, label, **params)
        scored = apply(model, f.where(F.col("fold") == i), features)
        areas.append(auc_pr(pr_curve(scored.where(F.col(label).isin(0, 1)), label, "score1")).first()[0] or 0.0)
    return sum(areas) / k


def tune(df: DataFrame, features: Sequence[str], key: str, grid: Sequence[dict], label: str = "label", k: int = 3) -> tuple[dict, float]:
    """The parameters with the greatest cross-validated area; of equals the first."""
    tried = [(cross_validated(df, features, key, label, k, **p), i) for i, p in enumerate(grid)]
    best, i = max(tried, key=lambda t: (t[0], -t[1]))
    return dict(grid[i]), best


def model_path(root: str, day: int) -> str:
    """One model a month: days of a month share it."""
    return f"{root.rstrip('/')}/{day // 100}"


def latest_per_month(days: DataFrame, day: str = "date") -> DataFrame:
    """First day of each month trains; later days of the month load."""
    first = F.min(day).over(Window.partitionBy(F.expr(f"{day} div 100")))
    return days.select(day).distinct().withColumn("trains", F.col(day) == first)
