"""Rank and agreement expressions, and order statistics that never gather a whole group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .bins import with_bins


def avg_rank(value: Column | str, *keys: str) -> Column:
    """Average rank of ties within keys, as a window expression. For groups that fit one task; see ranked() for others."""
    v = F.col(value) if isinstance(value, str) else value
    return F.rank().over(Window.partitionBy(*keys).orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, v)) - 1) / 2


def pct_rank(value: Column | str, *keys: str) -> Column:
    """Average rank over the number of rows: not SQL's percent_rank."""
    return avg_rank(value, *keys) / F.count(F.lit(1)).over(Window.partitionBy(*keys))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def below(df: DataFrame, keys: list[str], value: str, measures: dict[str, Column], lo: float = 0.0, hi: float = 1.0, bins: int = 4096, parts: int | None = None) -> DataFrame:
    """For each distinct value within keys: the measures' sums, and ``<name>_below``, the sums over all smaller values.

    Values are cut into bins that keep their order: of equal width between lo and hi, or, with ``parts``, of about equal numbers of different values, however these crowd. Running sums go over the few bins of a
    key and, in parallel, over the values of each (key, bin), so a key with a large share of the rows is dealt to many tasks.
    """
    cell = F.least(F.greatest(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(-1)), F.lit(bins)).cast("int")
    each = df.groupBy(*keys, value).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    if parts:
        each = with_bins(written(each), keys, value, parts)
    else:
        each = each.withColumn("_bin", cell)
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins_ = each.groupBy(*keys, "_bin").agg(*[F.sum(n).alias(f"_{n}") for n in measures])
    bins_ = bins_.select(*keys, "_bin", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_base") for n in measures])
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({f"_{n}_in": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in measures})
    joined = each.join(bins_, [*keys, "_bin"])
    return joined.select(*keys, value, *measures, *[(F.col(f"_{n}_in") + F.col(f"_{n}_base")).alias(f"{n}_below") for n in measures])


def ranked(df: DataFrame, keys: list[str], value: str, **grid) -> DataFrame:
    """df with avg_rank and pct_rank of value within keys. Null values are left out."""
    kept = df.filter(F.col(value).isNotNull())
    steps = below(kept, keys, value, {"n": F.lit(1)}, **grid)
    total = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    rank = (F.col("n_below") + (F.col("n") + 1) / 2).alias("avg_rank")
    return kept.join(steps, [*keys, value]).join(total, keys).select(*kept.columns, rank, (rank / F.col("_total")).alias("pct_rank"))


def numbered(df: DataFrame, value: Column, order: list[str], lo: float, hi: float, name: str = "_n", bins: int = 4096) -> DataFrame:
    """df with the position (from 0) of each row by value and then by order. Values are cut into bins between lo and hi, which are numbered in parallel."""
    rows = df.withColumn("_v", value)
    rows = rows.withColumn("_bin", F.least(F.greatest(F.floor((F.col("_v") - lo) / (hi - lo + 1) * bins), F.lit(-1)), F.lit(bins)).cast("int"))
    sizes = rows.groupBy("_bin").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    sizes = sizes.select("_bin", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_bin").orderBy("_v", *order)) - 1
    return rows.withColumn("_in", place).join(F.broadcast(sizes), "_bin").withColumn(name, F.col("_in") + F.col("_base")).drop("_v", "_bin", "_in", "_base")


def corr(a: Column | str, b: Column | str) -> Column:
    """Correlation as an aggregate; null where a side is constant (the built-in one raises an error there in ANSI mode)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
