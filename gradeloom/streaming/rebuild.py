"""Rebuilding of what became complete, batch by batch, from a growing folder of children."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of the keys by which children and results are laid out.
BUCKETS = 64


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def rebuild_stream(spark: SparkSession, source: str, schema: str, target: str, key: str, build: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A stream over the Parquet files of ``source`` (a folder, or one file): for the keys of each batch that have more children than their last result was built from, the key's rows are built anew from all its children.

    Children are kept below the checkpoint, by batch and part of the keys, and results in ``target`` the same way, so a batch reads the parts of its own keys alone: neither files of ``source`` that earlier
    batches have read nor other parts. The newest batch of a key counts (see current). A batch that is run again overwrites its own folders. Results carry _children, the number they were built from.
    """
    store = f"{checkpoint.rstrip('/')}/children"
    target = target.rstrip("/")
    kind = next(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema if f.name == key)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_bucket", bucket(key)).write.mode("overwrite").partitionBy("_bucket").parquet(f"{store}/_batch={number}")
        mine = spark.read.schema(f"{schema}, _bucket int").parquet(f"{store}/_batch={number}")
        parts = [r[0] for r in mine.select("_bucket").distinct().collect()]  # BUCKETS at most
        children = spark.read.schema(f"{schema}, _bucket int, _batch int").parquet(store).filter(F.col("_bucket").isin(parts) & (F.col("_batch") <= number))
        children = children.join(mine.select(key).distinct(), key, "left_semi").drop("_batch", "_bucket")
        counts = children.groupBy(key).agg(F.count("*").alias("_children"))
        if batches(spark, target):
            done = spark.read.schema(f"{kind}, _children bigint, _bucket int, _batch int").parquet(target).filter(F.col("_bucket").isin(parts) & (F.col("_batch") < number)).groupBy(key).agg(F.max("_children").alias("_done"))
            counts = counts.join(done, key, "left").filter("_done is null or _children > _done").drop("_done")
        built = build(children.join(counts, key, "left_semi")).join(counts, key)
        built.withColumn("_bucket", bucket(key)).write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/_batch={number}")

    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders: take the file's folder, and of it this file
        reader, source = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint.rstrip('/')}/state").trigger(availableNow=True).start()


def batches(spark: SparkSession, target: str) -> bool:
    """Whether the target has a batch's folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/_batch=*/_SUCCESS")
    return len(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []) > 0


def current(target: DataFrame, key: str) -> DataFrame:
    """The rows of each key's newest batch."""
    newest = target.groupBy(key).agg(F.max("_batch").alias("_batch"))
    return target.join(newest, [key, "_batch"], "left_semi")
