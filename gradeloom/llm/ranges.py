"""Dealing rows to parts that hold consecutive ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bounds(df: DataFrame, id_col: str, parts: int) -> list[int]:
    """Ids that cut the table into about equal parts: at most parts - 1 numbers reach the driver."""
    if parts < 2:
        return []
    cuts = df.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.25 / parts)
    return sorted({int(x) for x in cuts})


def part_of(id_col: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the id, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = ",".join(f"{b}L" for b in bounds)
    return F.expr(
        f"aggregate(array({','.join(map(str, steps))}), 0, (pos, step) -> "
        f"if(pos + step <= {len(bounds)} and element_at(array({table}), least(pos + step, {len(bounds)})) <= _key, pos + step, pos))"
    )


def deal_by_id(df: DataFrame, id_col: str, parts: int) -> DataFrame:
    """Adds _key (the id as a long) and _part: parts of consecutive ids, from 0."""
    bounds = id_bounds(df, id_col, parts)
    return df.withColumn("_key", F.col(id_col).cast("long")).withColumn("_part", part_of(F.col("_key"), bounds))
