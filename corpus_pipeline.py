"""A corpus pipeline: language ID, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents (doc_id, text, lang, source, n_chars); the
last one returns the packed pieces. A stage works on its predecessor's rows, which are written as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import as_bytes, materialize, table
from gradeloom.llm.decontam import contaminated_words
from gradeloom.llm.langid import identify, third, train_language_model
from gradeloom.llm.near_dups import near_duplicates as find_classes
from gradeloom.llm.packing import pack_best_fit
from gradeloom.llm.suffix_dedup import remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; learned from the labelled ones outside the held-out third."""
    model = train_language_model(docs.filter(F.coalesce(third() != 1, F.lit(False))))
    return identify(docs, model).filter(~F.col("rejected")).select(docs.columns)


#: Bytes of a repeated passage: over 50 words, at four letters and a blank each, have 255 bytes or more.
PASSAGE = 255


def key_of(doc_id: Column, text_md5: Column) -> Column:
    """A 128-bit key of a row's id and text."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), text_md5)))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", key_of(F.col("doc_id"), F.md5(as_bytes(F.col("text")))))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs (keyed) whose _key is not in keys: broadcast if they are few by count, else shuffled."""
    keys = materialize(keys.select("_key").distinct())
    return docs.join(F.broadcast(keys) if keys.count() <= 1_000_000 else keys, "_key", "left_anti").drop("_key")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id (of equal ids, the one with the least digest of its text)."""
    classes = find_classes(docs.select("doc_id", "text"), digests=True)
    others = classes.filter(~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_md5") == F.col("class_md5"))))
    docs = keyed(docs)
    kept = without(docs, others.select(key_of(F.col("doc_id"), F.col("text_md5")).alias("_key")))
    twice = docs.groupBy("_key").count().filter("count > 1").select("_key")  # rows of equal id and text
    if twice.limit(1).count():
        twice = materialize(twice)
        once = keyed(kept).join(twice, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")
        kept = without(keyed(kept), twice).unionByName(once)
    return kept


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes under a repeated string of PASSAGE bytes, and without the rest of a letter that this cuts apart."""
    kept = remove_repeats(docs, size=PASSAGE, seed=80, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars")))
    return kept.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}).select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null texts stay."""
    docs = keyed(docs)
    found = contaminated_words(docs.select("_key", "text"), table(spark, sf_dir, "benchmark"), id_col="_key")
    return without(docs, found.filter("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_best_fit(docs, keep_pieces=False)  # workers go on to other stages: keep their memory small


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
