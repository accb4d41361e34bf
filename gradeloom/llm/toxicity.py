"""Toxicity by class-conditional Kneser-Ney models of words, their beginnings and pairs of words (see word_pairs).

A text's evidence is the log ratio of the toxic to the ordinary model, normalised by length: over the whole text, over its few most telling words, and over what
stands out. A logistic curve over these, fitted on labelled rows that the counts did not see, gives the score. Counts cover all
labelled rows given and are summed by Spark; the tables grow with the corpus, and rare expressions fall back on counts that both classes share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, fetch, join_on, prepare, table
from .word_pairs import TOPS, broadcast_steps, train_words, with_words

FEATURES = [f"x{i}" for i in range(2 + len(TOPS))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (the last is the intercept), by Newton's method."""
    if not len(y):
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - centre) / scale, np.ones(len(y))]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return centre, scale, w


def score_of(fit, x: np.ndarray) -> np.ndarray:
    centre, scale, w = fit
    return 1 / (1 + np.exp(-np.clip(np.c_[(x - centre) / scale, np.ones(len(x))] @ w, -30, 30)))


def train_toxicity(labelled: DataFrame, *, text_col: str = "text", label_col: str = "toxic", fold_col: str = "fold", calibration_rows: int = 20_000, broadcast_rows: int = 24_000_000):
    """A model from rows with a text, a label 0 or 1 (others are ignored) and a fold: rows whose fold is 0 fit the logistic curve (at most about
    calibration_rows of them), all others are counted. Without rows of both labels every score is the labels' mean, or one half.

    Up to broadcast_rows steps of the model are broadcast; a larger table is joined."""
    spark = labelled.sparkSession
    prepare(spark)
    rows = labelled.select(as_bytes(F.col(text_col)).alias("raw"), F.col(label_col).cast("int").alias("y"), F.coalesce(F.col(fold_col).cast("int"), F.lit(1)).alias("fold")).filter("y in (0, 1)")
    words = train_words(rows.filter("fold <> 0").select("raw", "y"))
    tables = broadcast_steps(words, broadcast_rows)

    def measure(part: pd.DataFrame, found: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(found, columns=FEATURES).assign(y=part["y"].to_numpy())[["y", *FEATURES]]

    held = rows.filter("fold = 0")
    share = min(1.0, calibration_rows / max(1, held.count()))
    held = held.filter(F.pmod(F.xxhash64("raw"), F.lit(1_000_000)) < int(share * 1_000_000))
    x = with_words(held.select(F.col("raw").alias("_raw"), "y"), words, measure, "y int, " + ", ".join(f"{c} double" for c in FEATURES), tables)
    x = fetch(x).sort_values([*FEATURES, "y"])
    return words, fit_logistic(x[FEATURES].to_numpy(), x["y"].to_numpy(np.float64)), tables


def score_toxicity(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in ``keep``, score (0 to 1) and predicted (1 if score >= 0.5, else 0) of each row; null text counts as empty, null and repeated
    ids are kept row by row. Columns in ``keep`` must not be named score or predicted; other columns are ignored, whatever their names."""
    if {"score", "predicted"} & {id_col, *keep}:
        raise ValueError("score and predicted are the names of the result's columns")
    prepare(docs.sparkSession)
    words, fit, tables = model
    rows = docs.select(id_col, *keep, as_bytes(F.col(text_col)).alias("_raw"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", score double, predicted int"

    def run(part: pd.DataFrame, found: np.ndarray) -> pd.DataFrame:
        score = score_of(fit, found)
        return part.drop(columns="_raw").assign(score=score, predicted=(score >= 0.5).astype(np.int32))

    return with_words(rows, words, run, schema, tables)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document whose labels contradict each other counts as toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)).alias("rest"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = join_on(docs.filter("rest <> 0"), labels, "doc_id").withColumn("fold", F.when(F.col("rest") == 4, 0).otherwise(1))
    model = train_toxicity(labelled)
    return score_toxicity(docs.withColumn("held_out", F.coalesce(F.col("rest") == 0, F.lit(False))), model, keep=("held_out",)).select("doc_id", "held_out", "score", "predicted")
