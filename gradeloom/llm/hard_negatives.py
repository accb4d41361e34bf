"""Hard negatives by a vertical scan with branch and bound over columns of dimensions.

Vectors are held in blocks of rows, each a column a dimension with its least and greatest value. For an anchor a block's columns are read in the order of the
anchor's falling magnitudes; after every few columns the sum so far and the least and the most that the unread columns can add bound each candidate's score, and candidates that
can't be among the best any more leave the block's bitmap, so later columns are read for fewer rows. What is left when all columns are read has its exact score.

Anchors go in passes of a bounded number, which are broadcast; a pass reads all blocks twice: for the positives (same label), and then, with each positive's window of
scores known, for the negatives. Each task sends at most the asked number of rows an anchor and window; a limit on ranks before the shuffle keeps what reaches one window's task small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fetch, materialize, scratch_dir, table, temporary

SCALE = 256
#: Numbers of a block, its rows at most, and the columns that are read between two prunings.
NUMBERS, BLOCK, STRIDE = 1 << 18, 4096, 8
FAR = 1 << 62
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Block:
    """Rows by columns: values[j] is dimension j of all rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.least, self.most = columns.min(1), columns.max(1)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, low: int, high: int, k: int, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (of the places alive) and scores of all candidates that can be among the best k with a score in [low, t], for any t in tops (each at most high)."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        ends = np.stack((a * self.least[order], a * self.most[order]))
        rest_low, rest_high = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (ends.min(0), ends.max(0)))
        score = np.zeros(len(alive), np.int64)
        for lo in range(0, len(a), STRIDE):
            if not len(alive):
                break
            part = order[lo : lo + STRIDE]
            score += a[lo : lo + STRIDE] @ (self.columns[part] if len(alive) == self.columns.shape[1] else self.columns[np.ix_(part, alive)])
            done = min(lo + STRIDE, len(a))
            least, most = score + rest_low[done], score + rest_high[done]
            keep = (most >= low) & (least <= high)
            if len(alive) > 4 * k:
                useful = np.zeros(len(alive), bool)
                for t in tops:  # a candidate is of use to a window unless k others surely in it score higher
                    sure = least[(most <= t) & (least >= low)]
                    floor = max(low, int(np.partition(sure, -k)[-k])) if len(sure) >= k else low
                    useful |= (most >= floor) & (least <= t)
                keep &= useful
            if not keep.all():
                alive, score = alive[keep], score[keep]
        return alive, score


def best(block: Block, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places in rows of the k highest scores, ties by smaller id."""
    return np.lexsort((block.ids[rows], -scores))[:k]


def blocks_of(size: int):
    """Arrow batches to blocks: ids, labels, and the columns one after another."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, len(part), size):
                some = part.slice(lo, size)
                v = np.floor(SCALE * some.column("_v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(some), -1)
                if v.size and v.shape[1] * np.abs(v).max() ** 2 >= 2.0**62:
                    raise ArithmeticError("scores do not fit 63 bits")
                yield pa.record_batch({
                    "ids": pa.array([some.column("_id").to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()),
                    "labels": pa.array([some.column("_y").to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()),
                    "columns": pa.array([np.ascontiguousarray(v.T.astype(np.int64)).tobytes()], pa.binary()),
                })

    return run


def unpacked(part: pa.RecordBatch) -> Iterator[Block]:
    for ids, labels, columns in zip(*(part.column(c) for c in ("ids", "labels", "columns")), strict=True):
        ids = np.frombuffer(ids.as_py(), np.int64)
        yield Block(ids, np.frombuffer(labels.as_py(), np.int64), np.frombuffer(columns.as_py(), np.int64).reshape(-1, len(ids)))


def find_positives(shared, k: int):
    """Of each block the best k rows of each anchor's label: anchor, positive_id, positive_score."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        for part in parts:
            out = []
            for block in unpacked(part):
                places = {y: np.flatnonzero(block.labels == y) for y in np.unique(block.labels)}
                for number, own, y, vector in anchors:
                    alive = places.get(y)
                    if alive is None:
                        continue
                    alive = alive[block.ids[alive] != own]
                    rows, scores = block.scan(vector, alive, -FAR, FAR, k, np.array([FAR]))
                    top = best(block, rows, scores, k)
                    out.append((np.full(len(top), number), block.ids[rows[top]], scores[top]))
            if out:
                a, i, s = map(np.concatenate, zip(*out, strict=True))
                yield pa.record_batch({"anchor": pa.array(a.astype(np.int32)), "positive_id": pa.array(i), "positive_score": pa.array(s)})

    return run


def find_negatives(shared, k: int):
    """Of each block the best k rows in each window: anchor, place (of the positive), negative_id, negative_score. Windows of one anchor share a scan."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        for part in parts:
            out = []
            for block in unpacked(part):
                others = {y: np.flatnonzero(block.labels != y) for y in {a[2] for a in anchors}}
                for number, own, y, vector, windows in anchors:
                    low, high = min(w[1] for w in windows), max(w[2] for w in windows)
                    alive = others[y][block.ids[others[y]] != own]
                    rows, scores = block.scan(vector, alive, low, high, k, np.unique([w[2] for w in windows]))
                    for place, least, most in windows:
                        inside = np.flatnonzero((scores >= least) & (scores <= most))
                        if len(inside):
                            top = inside[best(block, rows[inside], scores[inside], k)]
                            out.append((np.full(len(top), number), np.full(len(top), place), block.ids[rows[top]], scores[top]))
            if out:
                a, p, i, s = map(np.concatenate, zip(*out, strict=True))
                yield pa.record_batch({"anchor": pa.array(a.astype(np.int32)), "place": pa.array(p.astype(np.int32)), "negative_id": pa.array(i), "negative_score": pa.array(s)})

    return run


def ranked(rows: DataFrame, keys: list[str], score: str, name: str, k: int) -> DataFrame:
    """The first k rows of each key by falling score and then by id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), name)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def prepared(rows: DataFrame, id_col: str, vector_col: str, label_col: str, relabel: bool) -> DataFrame:
    """_id, _y, _v of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & (F.size(v) > 0)
    y = F.col(label_col).cast("long")
    if relabel:
        y = F.when(F.col(id_col) % 7 == 0, F.pmod(y + 1, F.lit(10))).otherwise(y)
    return rows.filter(fine & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), y.alias("_y"), v.alias("_v"))


def hard_negatives(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    relabel: bool = False, anchors_a_pass: int = 20_000, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (id divisible by anchor_every) and each of its first ``positives`` rows of the same label, the
    first ``negatives`` rows of other labels with low * positive_score <= 100 * score <= high * positive_score. Scores are inner products of floor(256 x).

    Rows with a null id, label or vector, an empty vector, or a null, NaN or infinite component take no part, nor do vectors whose length is not the most frequent one. Ties go to the smaller id.
    Rows of the anchor's own id are not its positives or negatives. Repeated rows (equal id, label and vector) are one anchor, but candidates as often as they occur. An anchor
    without positives, or a positive without negatives, has no row; an empty table gives none; other columns are ignored. relabel: (label + 1) % 10 where the id is divisible by 7.
    """
    spark = rows.sparkSession
    fine = prepared(rows, id_col, vector_col, label_col, relabel)
    width = fine.groupBy(F.size("_v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if width is None:
        return spark.createDataFrame([], RESULT)
    fine = fine.filter(F.size("_v") == width["width"])
    block = max(1, min(block, NUMBERS // width["width"]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(block))
    blocks = materialize(fine.mapInArrow(blocks_of(block), "ids binary, labels binary, columns binary"))
    anchors = materialize(fine.filter(F.col("_id") % anchor_every == 0).distinct())
    passes = -(-anchors.count() // anchors_a_pass)
    path = scratch_dir(spark)
    anchors = anchors.withColumn("pass", F.pmod(F.xxhash64("_id", "_y", "_v"), F.lit(max(passes, 1))))
    for number in range(passes):
        some = fetch(anchors.filter(F.col("pass") == number).orderBy("_id", "_y"))
        vectors = [np.floor(SCALE * np.asarray(v, np.float64)).astype(np.int64) for v in some["_v"]]
        shared = spark.sparkContext.broadcast(list(zip(range(len(some)), some["_id"].tolist(), some["_y"].tolist(), vectors, strict=True)))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # blocks of 2 MB
        found = blocks.mapInArrow(find_positives(shared, positives), "anchor int, positive_id long, positive_score long")
        found = fetch(ranked(found, ["anchor"], "positive_score", "positive_id", positives)).sort_values(["anchor", "rank"])
        windows: dict[int, list] = {}
        for anchor, rank, score in zip(found["anchor"].tolist(), found["rank"].tolist(), found["positive_score"].tolist(), strict=True):
            if low * score <= high * score:  # else the window is empty
                windows.setdefault(anchor, []).append((rank - 1, -(-low * score // 100), high * score // 100))
        wanted = spark.sparkContext.broadcast([(*a, windows[a[0]]) for a in shared.value if a[0] in windows])
        found["place"] = (found["rank"] - 1).astype(np.int32)
        found["anchor_id"] = some["_id"].to_numpy()[found["anchor"].to_numpy()] if len(found) else pd.Series([], dtype=np.int64)
        pairs = spark.createDataFrame(found[["anchor", "place", "anchor_id", "positive_id", "positive_score"]], "anchor int, place int, anchor_id long, positive_id long, positive_score long")
        out = blocks.mapInArrow(find_negatives(wanted, negatives), "anchor int, place int, negative_id long, negative_score long")
        out = ranked(out, ["anchor", "place"], "negative_score", "negative_id", negatives).join(F.broadcast(pairs), ["anchor", "place"])  # a row an anchor and positive
        out = out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        out.write.parquet(f"{path}/pass={number}")
        wanted.unpersist()
        shared.unpersist()
    if not passes:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*[f"{temporary(spark, path)}/pass={number}" for number in range(passes)])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), relabel=True)
