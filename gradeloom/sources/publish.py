"""Output in two phases: a complete default first, then replacements that are staged, checked and swapped in; readers always find a whole version.

A version is a folder of its own below the output's root; the file CURRENT names the one that counts and is replaced by a rename. A replacement that fails its checks is
never named, so what was there before stays readable.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


class CheckFailed(ValueError):
    """The replacement was not published; the message says what is wrong with it."""


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _point(spark: SparkSession, root: str, version: str) -> None:
    jvm, at, fs = _files(spark, f"{root}/{POINTER}")
    staged = jvm.org.apache.hadoop.fs.Path(f"{root}/.{POINTER}-{version}")
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged, at, options)


def current_version(spark: SparkSession, root: str) -> str | None:
    """The name of the version that counts; None before the first."""
    _, at, fs = _files(spark, f"{root}/{POINTER}")
    if not fs.exists(at):
        return None
    rows = spark.read.text(f"{root}/{POINTER}").collect()  # one short line
    return rows[0]["value"]


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current_version(spark, root)}")


def problems(staged: DataFrame, ids: DataFrame, id_col: str, columns: list[str], lo: float = 0.0, hi: float = 1.0) -> list[str]:
    """What is wrong with a wide output: its columns and their order, ids that lack, are unknown or occur twice, null or NaN values, values out of [lo, hi]. Two jobs, whatever the number of checks."""
    wanted = [id_col, *columns]
    if staged.columns != wanted:
        return [f"columns are {staged.columns}, not {wanted}"]
    bad = {f"nulls in {c}": F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns}
    bad |= {f"values of {c} out of [{lo:g}, {hi:g}]": ~F.col(c).between(lo, hi) & ~F.isnan(F.col(c).cast("double")) for c in columns}
    counts = staged.agg(*[F.count_if(b).alias(n) for n, b in bad.items()]).first().asDict()
    both = ids.select(F.col(id_col)).groupBy(id_col).agg(F.count("*").alias("_w")).join(staged.groupBy(id_col).agg(F.count("*").alias("_s")), id_col, "full")
    keys = both.agg(F.count_if(F.col("_s").isNull()).alias("ids that lack"), F.count_if(F.col("_w").isNull()).alias("unknown ids"), F.count_if(F.col("_s") > 1).alias("ids that occur twice")).first().asDict()
    return [f"{n} {name}" for name, n in (counts | keys).items() if n]


def publish(df: DataFrame, root: str, ids: DataFrame, id_col: str, columns: list[str]) -> str:
    """Stage df below root, check it, and let it count; returns the version's name. CheckFailed leaves everything as it was."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    if found := problems(df.sparkSession.read.parquet(f"{root}/{version}"), ids, id_col, columns):
        raise CheckFailed("; ".join(found))
    _point(df.sparkSession, root, version)
    return version


def publish_default(ids: DataFrame, root: str, id_col: str, columns: list[str], value: float = 0.5) -> str:
    """The whole output with one value everywhere, written before the expensive part begins."""
    ids = ids.select(id_col).distinct()
    return publish(ids.select(id_col, *[F.lit(value).alias(c) for c in columns]), root, ids, id_col, columns)
