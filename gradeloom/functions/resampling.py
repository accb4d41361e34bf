"""Bootstrap replicates as vectors: every row keeps one place, and its weights in all replicates are one array.

The area under the curve of each replicate is a sum over rows in score order, so one pass over the sorted rows serves all replicates: running sums of weights are vectors. Rows are dealt by bins of
scores that a sketch of quantiles cuts, so that no bin but that of a single score holds many rows; such a score needs no order and is dealt to several tasks. A task goes through its sorted rows
in chunks and holds a chunk's weights and a few vectors, whatever the size of a bin. What the shuffle carries does not grow with the number of replicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .bins import with_bins

#: A prime below 2^31: products of two residues fit 63 bits in every engine.
PRIME = 2147483647
#: Distribution of a Poisson variable of mean 1, up to 6 draws.
CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
SALTS = 8


def uniform(key, replicate):
    """A number in [0, 1) from key and replicate (columns, or arrays of non-negative numbers) by arithmetic that every engine shares: two rounds of squares, so that replicates are no shifts of each other."""
    x = (key % PRIME * 48271 + replicate * 69621 + 12345) % PRIME
    for _ in range(2):
        x = (x * x % PRIME + x * 16807 + replicate * 7919) % PRIME
    return x / PRIME


def uniform_sql(key: str, replicate: str) -> str:
    x = f"(({key} % {PRIME} * 48271 + {replicate} * 69621 + 12345) % {PRIME})"
    for _ in range(2):
        x = f"(({x} * {x} % {PRIME} + {x} * 16807 + {replicate} * 7919) % {PRIME})"
    return f"({x} / {PRIME}.0::DOUBLE)"


def replicate_weight(key: Column, replicate: Column) -> Column:
    """A Poisson(1) bootstrap weight as a column."""
    u = uniform(key, replicate)
    return sum((F.when(u >= cut, 1).otherwise(0) for cut in CUTS), F.lit(0))


CUTS_SQL = " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in CUTS)


def weights(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """replicate_weight of all keys (rows) and replicates (columns)."""
    u = uniform(keys.astype(np.int64)[:, None], replicates.astype(np.int64)[None, :])
    return np.searchsorted(CUTS, u.reshape(-1), side="right").reshape(u.shape).astype(np.float64)


class Cell:
    """Running sums of one bin: weights of both classes, and weighted pairs in order (ties count half)."""

    def __init__(self, replicates: int):
        self.pos, self.neg, self.won = (np.zeros(replicates) for _ in range(3))
        self.tie = None  # score, and both classes' sums of it so far

    def close(self) -> None:
        if self.tie is not None:
            _, pos, neg = self.tie
            self.won += pos * (self.neg + neg / 2)
            self.pos += pos
            self.neg += neg
            self.tie = None

    def add(self, score: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """Rows in score order, which goes on from call to call."""
        first = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        pos, neg = np.add.reduceat(w * y[:, None], first), np.add.reduceat(w * (1 - y[:, None]), first)
        if self.tie is not None and self.tie[0] == score[0]:
            pos[0] += self.tie[1]
            neg[0] += self.tie[2]
        else:
            self.close()
        done = len(first) - 1
        if done:
            before = np.cumsum(neg[:done], axis=0) - neg[:done] + self.neg
            self.won += (pos[:done] * (before + neg[:done] / 2)).sum(0)
            self.pos += pos[:done].sum(0)
            self.neg += neg[:done].sum(0)
        self.tie = (score[-1], pos[-1], neg[-1])


def sum_cells(keys: list[str], replicates: int, chunk: int = 1024):
    """mapInPandas function over rows that are sorted by key, bin, salt and score: a row a bin with its three vectors."""
    names = [*keys, "_bin", "_salt"]
    numbers = np.arange(replicates)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cell, done = None, None, []

        def close() -> None:
            if at is not None:
                cell.close()
                done.append((*at, cell.pos, cell.neg, cell.won))

        for part in parts:
            if not len(part):
                continue
            new = (part[names].to_numpy(object)[1:] != part[names].to_numpy(object)[:-1]).any(1)
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(part)]
            score, y, entity = part["_p"].to_numpy(), part["_y"].to_numpy(np.float64), part["_e"].to_numpy()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                here = tuple(part[n].iloc[lo] for n in names)
                if here != at:
                    close()
                    at, cell = here, Cell(replicates)
                    if len(done) >= 128:
                        yield pd.DataFrame(done, columns=[*names, "pos", "neg", "won"])
                        done = []
                for s in range(lo, hi, chunk):
                    e = min(hi, s + chunk)
                    cell.add(score[s:e], y[s:e], weights(entity[s:e], numbers))
        close()
        yield pd.DataFrame(done, columns=[*names, "pos", "neg", "won"])

    return run


def merge_cells(keys: list[str]):
    """applyInPandas function over the bins of a key, at most 2 parts + 8 parts rows: the areas of all replicates."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_bin", kind="stable")
        won, below, total = 0.0, 0.0, 0.0
        for number, cell in part.groupby("_bin", sort=True):
            pos, neg = np.stack(cell["pos"]).sum(0), np.stack(cell["neg"]).sum(0)
            won = won + pos * below + (pos * neg / 2 if number % 2 else cell["won"].iloc[0])
            below, total = below + neg, total + pos
        with np.errstate(invalid="ignore", divide="ignore"):
            area = np.where(total * below > 0, won / (total * below), np.nan)
        return pd.DataFrame([(*(part[k].iloc[0] for k in keys), total, below, area)], columns=[*keys, "n_pos", "n_neg", "auc"])

    return run


def replicate_aucs(df: DataFrame, keys: list[str], entity: str, replicates: int, score: str = "p", y: str = "y", parts: int = 64) -> DataFrame:
    """keys, and the arrays n_pos, n_neg and auc, a place a replicate (null where a class has no weight): areas of resampled entities. A row's weight comes from its entity and the replicate alone, so rows of one
    entity are drawn together, under all keys: differences between keys are paired. Rows with a null label, score or entity are left out."""
    rows = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull() & F.col(entity).isNotNull())
    rows = rows.select(*keys, F.col(score).cast("double").alias("_p"), F.col(y).cast("int").alias("_y"), F.pmod(F.col(entity).cast("long"), F.lit(PRIME)).alias("_e"))
    rows = with_bins(written(rows), keys, "_p", parts)
    rows = rows.withColumn("_salt", F.when(F.col("_bin") % 2 == 1, F.pmod(F.xxhash64("_e"), F.lit(SALTS)).cast("int")).otherwise(0))
    order = [*keys, "_bin", "_salt"]
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    cells = rows.repartition(*order).sortWithinPartitions(*order, "_p").mapInPandas(sum_cells(keys, replicates), kinds + "_bin int, _salt int, pos array<double>, neg array<double>, won array<double>")
    return cells.groupBy(*keys).applyInPandas(merge_cells(keys), kinds + "n_pos array<double>, n_neg array<double>, auc array<double>")


def bootstrap(df: DataFrame, keys: list[str], entity: str, replicates: int, score: str = "p", y: str = "y") -> DataFrame:
    """keys, rep, auc (null where a class is missing): replicate_aucs with a row a replicate."""
    return replicate_aucs(df, keys, entity, replicates, score, y).select(*keys, F.posexplode("auc").alias("rep", "auc"))
