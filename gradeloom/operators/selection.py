"""What a choice made on few entities is worth: blend weights chosen on a drawn set, scored there and on all the others.

Ranks r1 and r2 of the two arms are taken once over all rows, and each trial chooses its weights by its drawn rows alone, a bounded number. The rows in order at a chosen weight give the area over all rows, and
of each drawn row the number of rows of the other class that it wins against (``won``). The area over the rows that were not drawn follows from these: from all pairs those with a drawn row are taken off and those
between two drawn rows, taken off twice, are added. So the table is put in order once for each different chosen weight, at most one a label and trial and, for weights that are means of a few bags, a few hundred.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.resampling import uniform, weights
from ..sources.tables import written

GRID = tuple(round(0.05 * i, 2) for i in range(21))
#: Trials draw by numbers from here on, bags within trials by numbers from there on.
TRIALS, BAGS = 5000, 100_000


#: Parts of [0, 1] by which scores are dealt to tasks.
BINS = 256


def placed_in_order(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (with y and p) with won, and by keys their area, n_pos and n_neg. Rows are shuffled once, by keys and a part of the scores, and keep their columns on the way: nothing is joined back to them but the small table of what stands in lower parts."""
    dealt = rows.withColumn("_bin", F.least(F.greatest(F.floor(F.col("p") * BINS), F.lit(-1)), F.lit(BINS)).cast("int"))
    sums = {"pos": F.col("y"), "neg": 1 - F.col("y")}
    lower = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(*keys, "_bin").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    whole_of = Window.partitionBy(*keys)
    bases = written(bases.select(*keys, "_bin", *[F.coalesce(F.sum(n).over(lower), F.lit(0)).alias(f"_{n}") for n in sums], F.sum("pos").over(whole_of).alias("n_pos"), F.sum("neg").over(whole_of).alias("n_neg")))
    upto, same = Window.partitionBy(*keys, "_bin").orderBy("p"), Window.partitionBy(*keys, "_bin", "p")
    there = dealt.withColumns({f"_{n}_{how}": F.sum(c).over(w) for n, c in sums.items() for how, w in (("upto", upto), ("same", same))})
    joined = there.join(bases.hint("shuffle_hash"), [*keys, "_bin"])
    half = lambda n: F.col(f"_{n}") + F.col(f"_{n}_upto") - F.col(f"_{n}_same") / 2
    won = F.when(F.col("y") == 1, half("neg")).otherwise(F.col("n_pos") - half("pos"))
    out = written(joined.select(*rows.columns, won.alias("won"), "n_pos", "n_neg"))
    whole = out.groupBy(*keys).agg(F.sum(F.when(F.col("y") == 1, F.col("won")).otherwise(0.0)).alias("area"), F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    return out.drop("n_pos", "n_neg"), written(whole)


def drawn(rows: DataFrame, id_col: str, trials: int, most: int) -> DataFrame:
    """trial, id, place: for each trial its ``most`` ids (all, if fewer) in a drawn order, from 1. Few more than needed get as far as the ordering."""
    ids = rows.select(id_col).distinct()
    n = ids.count()
    level = min(1.0, (most + 10 * most**0.5 + 20) / max(n, 1))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = part[id_col].to_numpy()
            for lo in range(0, len(ids), 2000):
                u = uniform((ids[lo : lo + 2000].astype(np.int64) % 2147483647)[:, None], (np.arange(trials, dtype=np.int64) + TRIALS)[None, :])
                row, trial = np.nonzero(u <= level)
                yield pd.DataFrame({id_col: ids[lo : lo + 2000][row], "trial": trial.astype(np.int32), "_u": u[row, trial]})

    kind = rows.schema[id_col].dataType.simpleString()
    found = ids.repartition(max(8, n // 20_000), id_col).mapInPandas(draw, f"`{id_col}` {kind}, trial int, _u double")
    order = Window.partitionBy("trial").orderBy("_u", id_col)
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("_u")


def areas(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted pairs won (ties half), and the weights of both classes, for each row of weights."""
    order = np.argsort(p, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(p[order]) != 0))
    w, y = w[:, order], y[order]
    pos, neg = np.add.reduceat(w * y, first, axis=1), np.add.reduceat(w * (1 - y), first, axis=1)
    return (pos * (np.cumsum(neg, axis=1) - neg / 2)).sum(1), pos.sum(1), neg.sum(1)


def ratio(won, pos, neg):
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(pos * neg > 0, won / (pos * neg), np.nan)


def score_keys(r1: np.ndarray, r2: np.ndarray, w: float) -> np.ndarray:
    """Blended scores as whole numbers of 1e-9."""
    return np.floor(((1 - w) * r1 + w * r2) * 1e9 + 0.5).astype(np.int64)


def choose(id_col: str, grid, bags: int):
    """applyInPandas function over the drawn rows of one size and trial: by label the weight of the highest area and the mean of those of ``bags`` resamples. A label without both classes among the drawn rows keeps weight 0."""
    grid = np.array(grid)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        size, trial = int(part["size"].iloc[0]), int(part["trial"].iloc[0])
        out = []
        for label, rows in part.sort_values(id_col).groupby("label"):
            y, r1, r2 = (rows[c].to_numpy(float) for c in ("y", "r1", "r2"))
            one = np.ones((1, len(y)))
            w = np.vstack((one, weights(rows[id_col].to_numpy() % 2147483647, BAGS + trial * bags + np.arange(bags)).T)) if bags else one
            here = np.round([ratio(*areas(score_keys(r1, r2, g), y, w)) for g in grid], 9)
            best = np.where(np.isnan(here[0]), 0, np.nan_to_num(here, nan=-1).argmax(0))
            out.append((size, trial, label, float(grid[best[0]]), float(round(grid[best[1:]].mean(), 6)) if bags else 0.0))
        return pd.DataFrame(out, columns=["size", "trial", "label", "w", "w_bagged"])

    return run


def choices(rows: DataFrame, id_col: str, *, sizes=(58, 150, 400, 1000, 2500), trials: int = 200, bags: int = 0, grid=GRID) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, label, y, r1, r2): the weights that each trial chooses (size, trial, label, w, w_bagged), and the drawn sets (size, trial, id). Sizes that leave no row are skipped."""
    n = rows.select(id_col).distinct().count()
    sizes = [s for s in sizes if s < n] or [0]
    sets = drawn(rows, id_col, trials, max(sizes))
    sets = written(sets.select("trial", id_col, F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda s: F.col("place") <= s)).alias("size")))
    picked = rows.filter(WHOLE).select(id_col, "label", "y", "r1", "r2").join(sets.hint("merge"), id_col)
    return written(picked.groupBy("size", "trial").applyInPandas(choose(id_col, grid, bags), "size int, trial int, label string, w double, w_bagged double")), sets


def selection_trials(rows: DataFrame, id_col: str, **options) -> tuple[DataFrame, DataFrame]:
    """What each trial chose, with the areas here, here_0, there, there_0 at w (see choices and score_chosen), and the drawn sets."""
    rows = written(rows)
    chosen, sets = choices(rows, id_col, **options)
    return chosen.join(score_chosen(rows, id_col, chosen, sets, "w").hint("merge"), ["size", "trial", "label"]), sets


#: Rows without a class or a rank stand in no order.
WHOLE = "y is not null and r1 is not null and r2 is not null"
#: Rows of a label for each part of its scores, and that a task holds in order at a time.
CELL = 50_000


def packed(k: np.ndarray, y: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Scores and classes in order, by the part of [0, 1] that they fall in: numbers of 4 bytes where these hold them (after a byte that says so), else of 8."""
    x = np.sort(k * 2 + y)
    part = np.clip((x >> 1) * parts // 1_000_000_000, 0, parts - 1)
    ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(x))
    out, lo = [], 0
    for hi in ends.tolist() if len(x) else []:
        one = x[lo:hi]
        fits = one[0] >= 0 and one[-1] < 1 << 32
        out.append((int(part[lo]), bytes([4 if fits else 8]) + one.astype("<u4" if fits else "<i8").tobytes()))
        lo = hi
    return out


def unpacked(data: list[bytes]) -> np.ndarray:
    return np.sort(np.concatenate([np.frombuffer(d, "<u4" if d[0] == 4 else "<i8", offset=1).astype(np.int64) for d in data]), kind="stable")


def pack_rows(wanted: dict[str, np.ndarray], parts: dict[str, int]):
    """mapInPandas function: all rows at each of their label's weights (g: its place among these), packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def emit(label: str) -> Iterator[pd.DataFrame]:
            y, r1, r2 = (np.concatenate(x) for x in zip(*held.pop(label), strict=True))
            for lo in range(0, len(wanted[label]), 32):
                out = [(label, g, *cell) for g, w in enumerate(wanted[label][lo : lo + 32], lo) for cell in packed(score_keys(r1, r2, w), y.astype(np.int64), parts[label])]
                yield pd.DataFrame(out, columns=["label", "g", "part", "data"])

        for batch in batches:
            for label, rows in batch.groupby("label"):
                held.setdefault(label, []).append(tuple(rows[c].to_numpy(float) for c in ("y", "r1", "r2")))
                if sum(len(x[0]) for x in held[label]) >= CELL:
                    yield from emit(label)
        for label in list(held):
            yield from emit(label)

    return run


def ask(wanted: dict[str, np.ndarray], parts: dict[str, int], picks: dict):
    """applyInPandas function over the drawn rows of one size and trial: by label, at weight 0 and at the picked one, the pairs won among the drawn rows, their classes' numbers, and the rows, packed."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        size, trial = int(part["size"].iloc[0]), int(part["trial"].iloc[0])
        out = []
        for label, rows in part.groupby("label"):
            y, r1, r2 = (rows[c].to_numpy(float) for c in ("y", "r1", "r2"))
            at = wanted[label]
            for g in {int(np.searchsorted(at, w)) for w in (0.0, picks[size, trial, label])}:
                k = score_keys(r1, r2, at[g])
                local = [float(x[0]) for x in areas(k, y, np.ones((1, len(y))))]
                out += [(label, g, b, size, trial, *local, data) for b, data in packed(k, y.astype(np.int64), parts[label])]
        return pd.DataFrame(out, columns=["label", "g", "part", "size", "trial", "pairs", "pos", "neg", "data"])

    return run


def settle(part: pd.DataFrame) -> pd.DataFrame:
    """Of one part of a label's scores at one weight: a row with the pairs won inside it and the classes' numbers, and one for each drawn set (size and trial) with what its rows of class 1 win less what those of class 0 lose there."""
    every = part["size"].isna().to_numpy()
    x = unpacked(part["data"][every].tolist())
    first = np.flatnonzero(np.append(True, x[1:] >> 1 != x[:-1] >> 1))
    value, ones = x[first] >> 1, np.add.reduceat(x & 1, first)
    zeros = np.diff(np.append(first, len(x))) - ones
    lower = {1: np.cumsum(zeros) - zeros / 2, 0: np.cumsum(ones) - ones / 2}
    label, g, number = part["label"].iloc[0], part["g"].iloc[0], part["part"].iloc[0]
    out = [(label, g, number, None, None, float((ones * lower[1]).sum()), int(ones.sum()), int(zeros.sum()))]
    for size, trial, data in part.loc[~every, ["size", "trial", "data"]].itertuples(index=False):
        q = unpacked([data])
        at, pos = np.searchsorted(value, q >> 1), (q & 1) == 1
        out.append((label, g, number, int(size), int(trial), float(lower[1][at[pos]].sum() - lower[0][at[~pos]].sum()), int(pos.sum()), int((~pos).sum())))
    return pd.DataFrame(out, columns=["label", "g", "part", "size", "trial", "won", "pos", "neg"]).astype({"size": "Int32", "trial": "Int32"})


def score_chosen(rows: DataFrame, id_col: str, chosen: DataFrame, sets: DataFrame, weight: str) -> DataFrame:
    """chosen's size, trial, label with here, here_0, there, there_0 (areas on the drawn rows and on all others) for the weights of column ``weight``, which need not be on the grid.

    The driver holds the picked weights: a number a size, trial and label. All rows are put in order once for each different weight of a label, as packed numbers of 4 bytes: a task sorts a chunk of rows at
    each weight, another settles one part of the scores at one weight, with the drawn rows that fall in it."""
    picks = {(r["size"], r["trial"], r["label"]): r[weight] for r in chosen.select("size", "trial", "label", weight).collect()}
    labels = {label for _, _, label in picks}
    wanted = {label: np.array(sorted({0.0, *(w for (_, _, x), w in picks.items() if x == label)})) for label in labels}
    rows = rows.filter(WHOLE).select(id_col, "label", F.col("y").cast("int").alias("y"), F.col("r1").cast("double").alias("r1"), F.col("r2").cast("double").alias("r2"))
    many = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    parts = {label: min(BINS, 1 + many[label] // CELL) for label in labels}
    drawn_rows = rows.join(sets.hint("merge"), id_col).groupBy("size", "trial")
    asked = written(drawn_rows.applyInPandas(ask(wanted, parts, picks), "label string, g int, part int, size int, trial int, pairs double, pos double, neg double, data binary"))
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, sum(many.values()) // CELL)
    every = rows.filter(F.col("label").isin(*labels)).repartition(tasks, id_col).mapInPandas(pack_rows(wanted, parts), "label string, g int, part int, data binary")
    every = every.select("label", "g", "part", F.lit(None).cast("int").alias("size"), F.lit(None).cast("int").alias("trial"), "data")
    cells = every.unionByName(asked.select(*every.columns)).groupBy("label", "g", "part")
    cells = written(cells.applyInPandas(settle, "label string, g int, part int, size int, trial int, won double, pos long, neg long"))

    whole_of = Window.partitionBy("label", "g")
    before = whole_of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.filter("size is null").withColumns({f"{n}_{how}": F.coalesce(F.sum(n).over(over), F.lit(0)) for n in ("pos", "neg") for how, over in (("below", before), ("all", whole_of))})
    base = written(base.withColumn("area", F.sum(F.col("won") + F.col("pos") * F.col("neg_below")).over(whole_of)).drop("size", "trial", "won", "pos", "neg"))
    won = F.col("won") + F.col("pos") * F.col("neg_below") + F.col("neg") * (F.col("pos_all") - F.col("pos_below"))
    keys = ["size", "trial", "label", "g"]
    outer = cells.filter("size is not null").join(base.hint("merge"), ["label", "g", "part"]).groupBy(*keys).agg(F.sum(won).alias("won"), *[F.first(c).alias(c) for c in ("area", "pos_all", "neg_all")])
    inner = asked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("pairs", "pos", "neg")])
    here = F.try_divide("pairs", F.col("pos") * F.col("neg"))
    there = F.try_divide(F.col("area") - F.col("won") + F.col("pairs"), (F.col("pos_all") - F.col("pos")) * (F.col("neg_all") - F.col("neg")))
    both = outer.join(inner.hint("merge"), keys).withColumns({"here": here, "there": there, "_last": F.max("g").over(Window.partitionBy("size", "trial", "label"))})
    return both.groupBy("size", "trial", "label").agg(*[F.max(F.when(F.col("g") == at, F.col(n))).alias(n + name) for name, at in (("", F.col("_last")), ("_0", F.lit(0))) for n in ("here", "there")])


def optimism(chosen: DataFrame, thresholds=(0.01, 0.02, 0.0273)) -> DataFrame:
    """By size: trials, mean claimed and realised gain of the macro area and their difference, the share of trials without a realised gain, and of those that claim at least each threshold."""
    both = lambda a: F.avg(F.when(F.col(a).isNotNull(), F.col(a)))
    t = chosen.groupBy("size", "trial").agg((both("here") - both("here_0")).alias("claimed"), (both("there") - both("there_0")).alias("realised")).dropna()
    r = lambda c: F.round(c, 6)
    tails = [r(F.avg((F.round("claimed", 9) >= x).cast("double"))).alias(f"p_claimed_{x * 10000:04.0f}") for x in thresholds]
    return t.groupBy("size").agg(
        F.count("*").alias("trials"), r(F.avg("claimed")).alias("claimed"), r(F.avg("realised")).alias("realised"), r(F.avg(F.col("claimed") - F.col("realised"))).alias("optimism"),
        r(F.avg((F.round("realised", 9) <= 0).cast("double"))).alias("p_no_gain"), *tails,
    )
