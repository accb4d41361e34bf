"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

#: Rows of one Arrow batch. Texts can be very long, so batches are kept short to bound a Python worker's memory.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python stages that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches, after which its Python worker gives free memory back to the system. Workers go on to other stages, and without it each keeps what its largest stage took."""

    @wraps(run)
    def wrapped(parts: Iterator) -> Iterator:
        yield from run(parts)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
            trim(0)

    return wrapped


def scratch_dir(spark: SparkSession) -> str:
    """A name of a new folder under spark.checkpoint.dir, which all executors share."""
    return f"{shared_folder(spark)}/gradeloom-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, path: str) -> str:
    """The path, of a folder that is there; it is deleted when the application ends."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


#: Whether the shuffle files of an execution are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, its lineage ends there, its shuffles leave the
    disk, and it survives the loss of executors. narrow: a table of a few numbers a row after a shuffle, written in one file for every four shuffle
    partitions, or two for each core if that is more."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(max(2 * spark.sparkContext.defaultParallelism, partitions(spark) // 4)) if narrow else df).write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(temporary(spark, path))


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for df, which nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def as_bytes(text: Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_on(df: DataFrame, side: DataFrame, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Inner join with a side of a few numbers a row: broadcast if its counted rows are at most broadcast_rows, else shuffled."""
    return df.join(F.broadcast(side) if side.count() <= broadcast_rows else side, key)


def letters(text: Column) -> Column:
    """Whether the text has a letter; false for null."""
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def fetch(df: DataFrame):
    """The rows on the driver, as pandas by Arrow; only for tables of a bounded size."""
    return df.toArrow().to_pandas()


BITS = 24


def only_near(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys may be among wanted's: a bitmap of fixed size, 2^18 numbers whatever the tables' sizes, is
    broadcast so that the other rows' texts need not be shuffled. A join still has to follow."""
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << BITS))
    bits = wanted.select((place / 64).cast("int").alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(keys)}), {1 << BITS}) % 64 as int))").alias("b"))
    bits = materialize(bits.groupBy("_word").agg(F.bit_or("b").alias("_bits")), narrow=True)
    near = rows.withColumn("_word", (place / 64).cast("int")).join(F.broadcast(bits), "_word")
    return near.filter(f"shiftright(_bits, cast(pmod(xxhash64({', '.join(keys)}), {1 << BITS}) % 64 as int)) & 1 = 1").drop("_word", "_bits")
