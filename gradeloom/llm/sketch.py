"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's shingles are its runs of five words (words are what blanks part; four blanks' places before the first word count too, so
that short texts have shingles). The sketch is the k least distinct 64-bit hashes, ascending, as base64 text. The union of two sets
has the k least of both sketches, so sketches merge, and estimate resemblance, containment and the number of distinct shingles;
for sets of at most k shingles these are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, partitions, prepare, table
from .ranges import deal_by_id
from .repeats import U, Hashes, word_symbols

K = 128
WIDTH = 5


def shingle_hashes(raw: bytes, width: int = WIDTH) -> np.ndarray:
    words, _ = word_symbols([raw])
    return Hashes(np.concatenate((np.full(width - 1, 7, U), words))).all(width) if len(words) else np.zeros(0, U)


def sketch(raw: bytes, k: int = K) -> np.ndarray:
    h = shingle_hashes(raw)
    if len(h) > 8 * k:  # the k least distinct ones are among these, if they are enough
        part = np.unique(np.partition(h, 4 * k)[: 4 * k])
        if len(part) >= k:
            return part[:k]
    return np.unique(h)[:k]


def pack(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(U)


def merge(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.zeros(0, U)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of the union that both hold; two empty sets resemble each other fully."""
    both = np.union1d(a, b)[:k]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean()) if len(both) else 1.0


def distinct(s: np.ndarray, k: int = K) -> float:
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of a's shingles that b holds; 1 if a has none."""
    return min(1.0, resemblance(a, b, k) * distinct(merge([a, b], k), k) / distinct(a, k)) if len(a) else 1.0


def merge_sketches(df: DataFrame, group_col: str, sketch_col: str = "fingerprint", k: int = K) -> DataFrame:
    """group_col, fingerprint and n_shingles (estimated) of the union of each group's sketches. Null sketches count as empty.

    Every task first merges its own rows of a group, then tasks by salt, then the rest: no step gathers a whole group.
    """
    kind = f"`{group_col}` {df.schema[group_col].dataType.simpleString()}, _salt int, fingerprint string"

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for part in parts:
            for g, salt, s in zip(part[group_col], part["_salt"], part["fingerprint"], strict=True):
                key = (None if pd.isna(g) else g, salt)
                held[key] = merge([held.get(key, np.zeros(0, U)), unpack(s)], k)
            if len(held) > 50_000:
                yield frame(held)
                held = {}
        yield frame(held)

    def frame(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(g, salt, pack(s)) for (g, salt), s in held.items()], columns=[group_col, "_salt", "fingerprint"])

    n = partitions(df.sparkSession)
    rows = df.select(group_col, F.lit(0).alias("_salt"), F.coalesce(F.col(sketch_col), F.lit("")).alias("fingerprint")).mapInPandas(step, kind)
    rows = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(16)).cast("int")).repartition(n, group_col, "_salt").mapInPandas(step, kind)


    def last(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in step(parts):
            yield part[[group_col, "fingerprint"]].assign(n_shingles=[distinct(unpack(s), k) for s in part["fingerprint"]])

    kind = f"`{group_col}` {df.schema[group_col].dataType.simpleString()}, fingerprint string, n_shingles double"
    return rows.withColumn("_salt", F.lit(0)).repartition(n, group_col).mapInPandas(last, kind)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows _part, _guest, _key, raw: every document in its part of consecutive ids, and as a guest in the part before if its id is its
    part's first, so that each part can be read alone. The first of all is a guest of the last part."""
    n = partitions(docs.sparkSession)
    rows = deal_by_id(docs.select(F.col(id_col), as_bytes(F.col(text_col)).alias("raw")), id_col, 4 * n).drop(id_col)
    least = F.coalesce("_key", F.lit(-(2**63)))
    firsts = sorted((r["_part"], r["f"]) for r in rows.groupBy("_part").agg(F.min(least).alias("f")).collect())  # a row a part
    before = {p: firsts[i - 1][0] for i, (p, _) in enumerate(firsts)}
    if not firsts:
        return rows.withColumn("_guest", F.lit(0))
    size = firsts[-1][0] + 1
    first, goes = [None] * size, [0] * size
    for p, f in firsts:
        first[p], goes[p] = f, before[p]
    lookup = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("_part") + 1)
    own = F.struct(F.col("_part").alias("p"), F.lit(0).alias("g"))
    guest = F.struct(lookup(goes).cast("int").alias("p"), F.lit(1).alias("g"))
    rows = rows.withColumn("_at", F.explode(F.when(least == lookup(first), F.array(own, guest)).otherwise(F.array(own))))
    return rows.select(F.col("_at.p").alias("_part"), F.col("_at.g").alias("_guest"), "_key", "raw")


def compare_next(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by _part, _guest, _key, raw."""
    last, out = None, []  # the document whose next one is still to come, in this part

    def close(key, text, own, next_text, next_own):
        n = len(text)
        cut = n // 4
        edited = text[: n - cut] + next_text[:cut]
        other = sketch(edited.encode())
        return (key, n, hashlib.sha256(edited.encode()).hexdigest(), pack(own), pack(other), resemblance(own, other), resemblance(own, next_own))

    columns = ["_key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for frame in parts:
        for part, guest, key, raw in zip(frame["_part"], frame["_guest"], frame["_key"], frame["raw"], strict=True):
            if last and last[0] != part:
                out.append(close(*last[1:], *last[2:]))  # alone in the table: its own next
                last = None
            if guest and last is None:
                continue
            text, own = raw.decode(), sketch(raw)
            if last:
                out.append(close(*last[1:], text, own))
            last = None if guest else (part, None if pd.isna(key) else key, text, own)
        yield pd.DataFrame(out, columns=columns).astype({"_key": "Int64"})
        out = []
    if last:
        yield pd.DataFrame([close(*last[1:], *last[2:])], columns=columns).astype({"_key": "Int64"})


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, and that of its text with the last quarter replaced by the start of the next document.

    Documents follow each other in ascending id order (null ids first, equal ids by text), the first after the last; a table of
    one row is its own next. Null counts as empty; two empty texts are alike (1.0); other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = with_next(docs, id_col, text_col)
    rows = rows.repartition(partitions(spark), "_part").sortWithinPartitions("_part", "_guest", "_key", "raw")
    out = rows.select("_part", "_guest", "_key", "raw").mapInPandas(
        compare_next, "_key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return out.withColumnRenamed("_key", id_col)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
