"""A baseline model from metadata, scored out of fold."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import auc
from ..sources.tables import written
from .folds import deal


def out_of_fold(rows: DataFrame, id_col: str, labels: list[str], features: list[str], folds: int = 5, min_class: int = 5, estimator=None) -> DataFrame:
    """label, n_pos, n_neg, auc: for each label, boosted trees fitted on all folds but one score that one; the AUC is over all folds' scores together.

    Folds are stratified by the label. A label with fewer than min_class rows of a class has no AUC. Rows with a null label are left out.
    """
    estimator = estimator or GBTClassifier(maxIter=10, maxDepth=3, seed=1)
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    out = []
    for label in labels:
        known = rows.filter(F.col(label).isNotNull()).select(id_col, F.col(label).cast("double").alias("label"), "features")
        n = known.groupBy("label").count().collect()  # two rows
        counts = {r["label"]: r["count"] for r in n}
        n_pos, n_neg = counts.get(1.0, 0), counts.get(0.0, 0)
        if min(n_pos, n_neg) < min_class:
            out.append(rows.sparkSession.createDataFrame([(label, n_pos, n_neg, None)], "label string, n_pos long, n_neg long, auc double"))
            continue
        even, left = deal(known, id_col, [F.col("label")], folds)
        fold = even.unionByName(left.select(id_col, F.pmod(F.xxhash64(id_col), F.lit(folds)).cast("int").alias("fold")))
        known = written(known.join(fold, id_col))
        parts = []
        for k in range(folds):
            model = estimator.fit(known.filter(F.col("fold") != k))
            parts.append(model.transform(known.filter(F.col("fold") == k)).select(F.lit(label).alias("name"), "label", vector_to_array("probability")[1].alias("p")))
        scored = reduce(DataFrame.unionByName, parts).withColumn("y", F.col("label").cast("long"))
        out.append(auc(scored, ["name"]).select(F.col("name").alias("label"), "n_pos", "n_neg", F.round("auc", 6).alias("auc")))
    return reduce(DataFrame.unionByName, out)
