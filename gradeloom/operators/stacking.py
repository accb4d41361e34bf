"""Using the labels' scores for each other: the first principal component of their logits, and a stacker outside folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logit(c: Column, least: float = 1e-6) -> Column:
    p = F.least(F.greatest(c, F.lit(least)), F.lit(1 - least))
    return F.log(p / (1 - p))


def first_component(rows: DataFrame, scores: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Means of the logits, their first principal direction and its share of the variance; the covariance is one aggregate, a number for each pair of scores."""
    x = rows.select(*[logit(F.col(c)).alias(c) for c in scores]).dropna()
    pairs = [(i, j) for i in range(len(scores)) for j in range(i, len(scores))]
    r = x.agg(*[F.avg(c) for c in scores], *[F.covar_pop(scores[i], scores[j]) for i, j in pairs]).first()
    if r[0] is None:
        return np.zeros(len(scores)), np.zeros(len(scores)), 0.0
    v = np.zeros((len(scores), len(scores)))
    for (i, j), c in zip(pairs, r[len(scores) :], strict=True):
        v[i, j] = v[j, i] = c
    e, w = np.linalg.eigh(v)
    return np.array(r[: len(scores)]), w[:, -1], float(e[-1] / e.sum()) if e.sum() > 0 else 0.0


def shrink_first_component(rows: DataFrame, scores: list[str], keep: float) -> tuple[DataFrame, float]:
    """rows with scores whose logits have the first principal component times ``keep``, and that component's share of the variance. A row without one of the scores keeps its own."""
    mean, direction, share = first_component(rows, scores)
    along = sum(((logit(F.col(c)) - float(m)) * float(d) for c, m, d in zip(scores, mean, direction, strict=True)), F.lit(0.0))
    moved = {c: F.coalesce(1 / (1 + F.exp(-(logit(F.col(c)) - (1 - keep) * F.col("_along") * float(d)))), F.col(c)) for c, d in zip(scores, direction, strict=True)}
    return rows.withColumn("_along", along).withColumns(moved).drop("_along"), share


def stack(rows: DataFrame, scores: list[str], labels: list[str], fold: str) -> DataFrame:
    """rows with each label's score replaced by a logistic regression of its truth (y_<label>) on all scores' logits, fitted on the other folds. Rows with a null score, label or fold are left out; a fold whose others
    lack a class of a label gets their share of ones."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = rows.dropna(subset=[*scores, fold, *[f"y_{n}" for n in labels]])
    x = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(scores))], outputCol="_v").transform(x.withColumns({f"_x{i}": logit(F.col(c)) for i, c in enumerate(scores)})).drop(*[f"_x{i}" for i in range(len(scores))])
    out = None
    for number in sorted(r[0] for r in x.select(fold).distinct().collect()):  # folds are few
        inside, outside = x.filter(F.col(fold) == number), x.filter(F.col(fold) != number)
        for n in labels:
            y = f"y_{n}"
            seen = outside.agg(F.min(y), F.max(y), F.avg(y)).first()
            if seen[0] is None or seen[0] == seen[1]:
                inside = inside.withColumn(n, F.lit(seen[2]).cast("double"))
                continue
            model = LogisticRegression(featuresCol="_v", labelCol=y, regParam=0.01, maxIter=25, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(outside)
            inside = model.transform(inside).withColumn(n, vector_to_array("_p")[1]).drop("_p", "_r", "_c")
        inside = inside.drop("_v")
        out = inside if out is None else out.unionByName(inside)
    return x.drop("_v") if out is None else out
