"""Bins of about equal numbers of rows, by a sketch of each key's quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_points(df: DataFrame, keys: list[str], value: str, parts: int, accuracy: int = 2000) -> DataFrame:
    """keys, _cuts: for each key, about parts - 1 different values that cut its rows into parts of about equal numbers, in groups of 16."""
    q = F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(accuracy))
    flat = df.groupBy(*keys).agg(F.array_sort(F.array_distinct(q)).alias("_flat"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("_flat") - 1) / 16).cast("int")), lambda i: F.slice("_flat", i * 16 + 1, 16))
    return flat.select(*keys, groups.alias("_cuts"), F.transform(groups, lambda g: g[0]).alias("_heads"))


def bin_of(value: Column) -> Column:
    """2 i + 1 for the i-th cut itself, 2 i for values between the cuts before and at i: two short steps instead of one over all cuts."""
    head = F.greatest(F.size(F.filter("_heads", lambda h: h <= value)), F.lit(1)) - 1
    group = F.element_at("_cuts", head + 1)
    within = F.size(F.filter(group, lambda c: c < value))
    return head * 32 + within * 2 + F.when(F.array_contains(group, value), 1).otherwise(0)


def with_bins(df: DataFrame, keys: list[str], value: str, parts: int, few: int = 100_000) -> DataFrame:
    """df with _bin. Cuts of a counted, small number of keys are broadcast."""
    cuts = cut_points(df, keys, value, parts)
    if keys:
        cuts = F.broadcast(cuts) if cuts.limit(few + 1).count() <= few else cuts
        joined = df.join(cuts, keys)
    else:
        joined = df.crossJoin(F.broadcast(cuts))  # one row
    return joined.withColumn("_bin", bin_of(F.col(value))).drop("_cuts", "_heads")
