"""Readers of the input tables, schema checks and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class MissingColumns(ValueError):
    pass


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns; else an error that names those it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return require(df, *columns).select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a header; texts may hold line breaks and doubled quotes. The schema is given, not inferred."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


#: How write_csv puts a null, and what stands for a backslash and for NUL in a text (which the CSV parser drops before a quote). No text is written as NULL, as its backslashes are replaced.
NULL, MARKS = "\\N", (("\\", "\\b"), ("\0", "\\0"))


def write_csv(df: DataFrame, path: str | None = None) -> str:
    """Write df as CSV that read_written_csv reads back as it was, into a new folder of the shared one unless a path is given; returns the path."""
    path = path or f"{shared_folder(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    out = replaced(df, MARKS)
    out.write.csv(path, header=True, escape='"', quoteAll=True, nullValue=NULL, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def read_written_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """What write_csv wrote: nulls and empty texts stay apart, and every character of a text is kept."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', nullValue=NULL, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="FAILFAST")
    return replaced(df, [(b, a) for a, b in reversed(MARKS)])


def replaced(df: DataFrame, marks) -> DataFrame:
    """df with each pair's first text replaced by its second in all columns of texts."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "string":
            c = F.col(f"`{name}`")
            for a, b in marks:
                c = F.replace(c, F.lit(a), F.lit(b))
            out[name] = c
    return df.withColumns(out)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may do without; it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: computed once for several readers, and safe when executors are lost. The files go when the application ends."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_long(df: DataFrame, ids: list[str], labels: list[str], name: str = "label", value: str = "y") -> DataFrame:
    return df.unpivot(ids, labels, name, value)


def to_wide(df: DataFrame, ids: list[str], labels: list[str], name: str = "label", value: str = "p") -> DataFrame:
    return df.groupBy(*ids).pivot(name, labels).agg(F.first(value))


def matrix_rows(df: DataFrame, ids: list[str], names: Column, values: Column, expected: list[str]) -> DataFrame:
    """ids, label, p: a row a cell of a matrix that has its labels in every row. Labels that differ from the expected ones, or stand in another order, raise an error, as do rows of another length."""
    fine = (names == F.array(*map(F.lit, expected))) & (F.size(values) == len(expected))
    checked = F.when(fine, F.arrays_zip(names.alias("label"), values.alias("p"))).otherwise(F.raise_error(F.concat(F.lit("labels are "), F.coalesce(F.array_join(names, ", "), F.lit("null")))))
    return df.select(*ids, F.inline(checked)).toDF(*ids, "label", "p")


def registry(sources: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """All sources that have the columns, one below the other, with their name in ``source``."""
    out = None
    for name, df in sources.items():
        if set(columns) <= set(df.columns):
            part = df.select(*columns).withColumn("source", F.lit(name))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise MissingColumns(f"no source has {', '.join(columns)}")
    return out
