"""Metrics as SQL functions, for queries written in SQL: scalar ones from counts and sums, and table-valued ones over a table of scores.

The table of scores is put in order once, by key and different score (see ``below``); the functions aggregate that view, so no label is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written
from .ranks import below

#: name, arguments, result, body
SCALARS = {
    "rank_auc": ("rank_sum DOUBLE, n_pos DOUBLE, n_neg DOUBLE", "DOUBLE", "try_divide(rank_sum - n_pos * (n_pos + 1) / 2, n_pos * n_neg)"),
    "pct_rank": ("smaller BIGINT, equal BIGINT, total BIGINT", "DOUBLE", "(smaller + (equal + 1) / 2) / total"),
    "wilson": (
        "k DOUBLE, n DOUBLE", "STRUCT<low: DOUBLE, high: DOUBLE>",
        """named_struct('low', greatest(0D, (k / n + 1.96D * 1.96D / (2 * n) - 1.96D * sqrt(k / n * (1 - k / n) / n + 1.96D * 1.96D / (4 * n * n))) / (1 + 1.96D * 1.96D / n)),
            'high', least(1D, (k / n + 1.96D * 1.96D / (2 * n) + 1.96D * sqrt(k / n * (1 - k / n) / n + 1.96D * 1.96D / (4 * n * n))) / (1 + 1.96D * 1.96D / n)))""",
    ),
}


def register_scalars(spark: SparkSession) -> None:
    """rank_auc(rank_sum, n_pos, n_neg), pct_rank(smaller, equal, total) and wilson(k, n), for this session."""
    for name, (arguments, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")


def register_scores(scores: DataFrame, name: str = "scored_steps") -> None:
    """Of scores (arm, label, y, p): the view ``name`` (arm, label, p, pos, neg, n, pos_below, neg_below, n_below), and the table functions auc_of(arm) -> label, n_pos, n_neg, auc and ranks_of(arm) -> label, p,
    avg_rank, pct_rank. Rows with a null label or score are left out."""
    spark = scores.sparkSession
    register_scalars(spark)
    rows = scores.filter("y is not null and p is not null")
    written(below(rows, ["arm", "label"], "p", {"pos": F.col("y"), "neg": 1 - F.col("y"), "n": F.lit(1)})).createOrReplaceTempView(name)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION auc_of(which STRING) RETURNS TABLE(label STRING, n_pos BIGINT, n_neg BIGINT, auc DOUBLE)
        RETURN SELECT label, sum(pos), sum(neg), rank_auc(sum(pos * (n_below + (n + 1) / 2)), sum(pos), sum(neg)) FROM {name} WHERE arm = which GROUP BY label""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION ranks_of(which STRING) RETURNS TABLE(label STRING, p DOUBLE, avg_rank DOUBLE, pct_rank DOUBLE)
        RETURN SELECT s.label, s.p, s.n_below + (s.n + 1) / 2, pct_rank(s.n_below, s.n, t.total)
        FROM {name} s JOIN (SELECT label, sum(n) AS total FROM {name} WHERE arm = which GROUP BY label) t ON s.label = t.label WHERE s.arm = which""")
