"""Normalising header-like metadata: protocol, slots, sides, fingerprints, physical order, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighting(desc: Column, kind: Column, tr: Column, te: Column) -> Column:
    """The cascade T1 / T2 / PD by name, then gradient echo by kind, then by repetition and echo time; UNK at last. Null times match nothing."""
    t1, t2, pd = (desc.rlike(rf"\b{w}") for w in ("t1", "t2", "pd"))
    return (
        F.when(t1 & ~t2 & ~pd, "T1").when(t2 & ~pd, "T2").when(pd, "PD").when(kind == "GR", "GRE").when(tr < 800, "T1").when(te > 60, "T2").when(tr >= 800, "PD").otherwise("UNK")
    )


def token_in(options: Column, *tokens: str) -> Column:
    """Whether an exact token of a pipe-separated list is among those given (never a part of one)."""
    return F.exists(F.split(F.upper(options), r"\|"), lambda t: F.trim(t).isin(*tokens))


def side(tag: Column, x: Column, threshold: float = -62.0) -> tuple[Column, Column]:
    """Side and where it comes from: a tag that is not blank, else the position; NaN and null give none."""
    tag = F.nullif(F.trim(tag), F.lit(""))
    by_x = F.when(x.isNull() | F.isnan(x), None).when(x < threshold, "R").otherwise("L")
    return F.coalesce(tag, by_x), F.when(tag.isNotNull(), "tag").when(by_x.isNotNull(), "geometry").otherwise("none")


def centre_side(middle: Column, dead_zone: float = 20.0) -> Column:
    return F.when(F.abs(middle) >= dead_zone, F.when(middle < 0, "R").otherwise("L"))


def fingerprint(df: DataFrame, key: str, categories: list[str], number: str) -> DataFrame:
    """key and its fingerprint: the modes (least of ties) of the categories and the rounded median of a number, nulls written as NA."""
    modes = [F.mode(c, True).alias(f"_{c}") for c in categories]
    g = df.groupBy(key).agg(*modes, F.bround(F.median(number), 3).alias("_n"))
    parts = [F.coalesce(F.col(f"_{c}").cast("string"), F.lit("NA")) for c in categories] + [F.when(F.col("_n").isNull(), "NA").otherwise(F.format_string("%.3f", "_n"))]
    return g.select(key, F.concat_ws("|", *parts).alias("fingerprint"))


def physical_order(df: DataFrame, key: str, position: Column, fallback: str) -> DataFrame:
    """df with ``place``: the order by position along the axis, or by the fallback number where a key has a row without one; and ``ok``."""
    w = Window.partitionBy(key)
    rows = df.withColumn("_p", position)
    rows = rows.withColumn("ok", F.count(F.when(F.col("_p").isNull(), 1)).over(w) == 0)
    order = F.when(F.col("ok"), F.col("_p")).otherwise(F.col(fallback).cast("double"))
    return rows.withColumn("place", F.row_number().over(w.orderBy(order, fallback))).drop("_p")


def completeness(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key and action: ``new`` keys that the target lacks, ``rebuild`` those with more children in the source now, ``skip`` the rest."""
    s = source.groupBy(key).agg(F.count("*").alias("_s"))
    t = target.groupBy(key).agg(F.count("*").alias("_t"))
    return s.join(t, key, "left").select(key, F.when(F.col("_t").isNull(), "new").when(F.col("_s") > F.col("_t"), "rebuild").otherwise("skip").alias("action"))
