"""Tie-correct rank metrics over long tables (entity, label, y, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import below


def auc(df: DataFrame, keys: list[str], score: str = "p", y: str = "y", weight: Column | None = None, **grid) -> DataFrame:
    """keys, n_pos, n_neg (weighted), auc: ties count half; null where a class is missing. Rows with a null label or score are left out."""
    w = F.lit(1) if weight is None else weight
    rows = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    steps = below(rows, keys, score, {"pos": w * F.col(y), "neg": w * (1 - F.col(y))}, **grid)
    sums = steps.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("_won"))
    return sums.select(*keys, "n_pos", "n_neg", F.try_divide(F.col("_won"), F.col("n_pos") * F.col("n_neg").cast("double")).alias("auc"))


def macro(aucs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over the labels that have both classes."""
    return aucs.groupBy(*keys).agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("n_labels"))


def hanley_se(a: Column, n_pos: Column, n_neg: Column) -> Column:
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    return F.sqrt(F.greatest(F.lit(0.0), (a * (1 - a) + (n_pos - 1) * (q1 - a * a) + (n_neg - 1) * (q2 - a * a)) / (n_pos * n_neg)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def balanced_accuracy(y: Column, score: Column, threshold: float = 0.5) -> Column:
    hit = lambda of, yes: F.avg(F.when(of, yes.cast("double")))
    return (hit(y == 1, score >= threshold) + hit(y == 0, score < threshold)) / 2
