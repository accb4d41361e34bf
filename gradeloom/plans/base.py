"""What the queries share: registration, and the long table of labels and scores that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table, to_long

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def gold(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, source, n_chars, label, y of labelled documents."""
    labels = to_long(table(spark, d, "labels", "doc_id", "quality", "toxic"), ["doc_id"], ["quality", "toxic"])
    return labels.join(table(spark, d, "documents", "doc_id", "lang", "source", "n_chars"), "doc_id")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """gold with three arms of scores, from integer arithmetic: a is noise, b has many ties, c follows the label."""
    k = F.when(F.col("label") == "quality", 1).otherwise(2)
    arms = {
        "a": F.pmod(F.col("doc_id") * 7919 + k * 101, F.lit(1009)) / 1009.0,
        "b": F.pmod(F.col("n_chars") * 31 + k * 17, F.lit(97)) / 97.0,
        "c": (F.col("y") * 400 + F.pmod(F.col("doc_id") * 613 + k * 29, F.lit(1000))) / 1400.0,
    }
    rows = gold(spark, d).select("*", F.explode(F.create_map(*[x for n, p in arms.items() for x in (F.lit(n), p)])).alias("arm", "p"))
    return rows


GOLD = """gold AS (
    SELECT l.doc_id, d.lang, d.source, d.n_chars, l.label, l.y FROM (
        SELECT doc_id, 'quality' AS label, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) l
    JOIN documents d USING (doc_id))"""
SCORED = (
    GOLD
    + """, kk AS (SELECT *, CASE WHEN label = 'quality' THEN 1 ELSE 2 END AS k FROM gold),
scored AS (
    SELECT doc_id, lang, source, n_chars, label, y, 'a' AS arm, ((doc_id * 7919 + k * 101) % 1009) / 1009.0::DOUBLE AS p FROM kk
    UNION ALL SELECT doc_id, lang, source, n_chars, label, y, 'b', ((n_chars * 31 + k * 17) % 97) / 97.0::DOUBLE FROM kk
    UNION ALL SELECT doc_id, lang, source, n_chars, label, y, 'c', (y * 400 + (doc_id * 613 + k * 29) % 1000) / 1400.0::DOUBLE FROM kk)"""
)
#: ranks of p within (arm, label), and AUC by (arm, label)
RANKED = (
    SCORED
    + """, ranked AS (
    SELECT *, rank() OVER (PARTITION BY arm, label ORDER BY p) + (count(*) OVER (PARTITION BY arm, label, p) - 1) / 2.0::DOUBLE AS avg_rank,
        count(*) OVER (PARTITION BY arm, label) AS n FROM scored)"""
)
AUCS = (
    RANKED
    + """, aucs AS (
    SELECT arm, label, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg,
        (sum(y * avg_rank) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE AS auc FROM ranked GROUP BY arm, label)"""
)
