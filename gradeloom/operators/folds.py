"""Group-atomic, label-balanced folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deal(groups: DataFrame, group_col: str, signature: list[Column], folds: int) -> tuple[DataFrame, DataFrame]:
    """Groups of equal signature dealt evenly, ``folds`` at a time: (group, fold), and those left over, fewer than folds a signature.

    The groups of a signature are numbered within slices that are dealt to many tasks; slices are put one behind the other by their counts.
    """
    names = [f"_s{i}" for i in range(len(signature))]
    rows = groups.withColumns(dict(zip(names, signature, strict=True)) | {"_slice": F.pmod(F.xxhash64(group_col), F.lit(32))})
    counts = rows.groupBy(*names, "_slice").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*names)
    counts = counts.select(*names, "_slice", (F.sum("_c").over(w.orderBy("_slice")) - F.col("_c")).alias("_base"), F.sum("_c").over(w).alias("_all"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*names, "_slice").orderBy(group_col)) - 1)
    rows = rows.join(counts, [*names, "_slice"]).withColumn("_r", F.col("_r") + F.col("_base"))
    even = F.col("_r") < F.floor(F.col("_all") / folds) * folds
    # each signature begins at a fold of its own, so that no fold is always first
    fold = F.pmod(F.col("_r") + F.xxhash64(*names), F.lit(folds)).cast("int")
    return rows.filter(even).select(group_col, fold.alias("fold")), rows.filter(~even).select(groups.columns)


def assign_folds(groups: DataFrame, group_col: str, size_col: str, label_cols: list[str], folds: int = 5, most: int = 100_000) -> DataFrame:
    """(group, fold): one fold a group, sizes and label sums balanced.

    Groups of equal size and label sums are dealt evenly; what is left over is dealt by coarser signatures (powers of two), and only the
    rest of that, fewer than folds for each coarse signature, is placed greedily on the driver: largest
    first, each where the shares of all columns then vary least. With many label columns that rest may be long; if it has over ``most`` rows, it is dealt by size alone before.
    """
    columns = [size_col, *label_cols]
    groups = groups.select(group_col, *columns)
    first, left = deal(groups, group_col, [F.col(c) for c in columns], folds)
    second, left = deal(left, group_col, [F.floor(F.log2(F.col(c) + 1)) for c in columns], folds)
    dealt = first.unionByName(second)
    if left.count() > most:  # fewer than folds for each power of two of the size are left then
        third, left = deal(left, group_col, [F.floor(F.log2(F.col(size_col) + 1))], folds)
        dealt = dealt.unionByName(third)
    start = np.zeros((folds, len(columns)))
    for r in dealt.join(groups, group_col).groupBy("fold").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        start[r["fold"]] = [r[c] for c in columns]
    rows = sorted((tuple(r) for r in left.collect()), key=lambda r: (-r[1], str(r[0])))
    total = np.maximum(start.sum(0) + np.array([r[1:] for r in rows], float).reshape(-1, len(columns)).sum(0), 1)
    placed = []
    for name, *values in rows:
        cost = [np.std((start + np.eye(folds)[k][:, None] * values) / total, axis=0).mean() for k in range(folds)]
        best = int(np.argmin(cost))
        start[best] += values
        placed.append((name, best))
    kind = groups.schema[group_col].dataType.simpleString()
    return dealt.unionByName(groups.sparkSession.createDataFrame(placed, f"`{group_col}` {kind}, fold int"))


def fold_report(rows: DataFrame, fold_col: str, group_col: str, label_cols: list[str]) -> DataFrame:
    """fold, n, rate of each label, and split: the groups of the fold that also have rows in another one."""
    spread = rows.groupBy(group_col).agg(F.countDistinct(fold_col).alias("_k")).filter("_k > 1").select(group_col, F.lit(1).alias("_split"))
    rates = [F.round(F.avg(c), 6).alias(c) for c in label_cols]
    return rows.join(spread, group_col, "left").groupBy(fold_col).agg(F.count("*").alias("n"), *rates, F.countDistinct(F.when(F.col("_split") == 1, F.col(group_col))).alias("split"))
