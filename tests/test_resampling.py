"""Vector bootstrap and selection experiments against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeloom.functions.bins import bin_of, cut_points, with_bins
from gradeloom.functions.metrics import auc
from gradeloom.functions.resampling import Cell, bootstrap, replicate_aucs, replicate_weight, weights
from gradeloom.operators.selection import GRID, choose, drawn, optimism, score_chosen, selection_trials


def area(p, y, w=None):
    w = np.ones(len(p)) if w is None else w
    won = sum(w[i] * w[j] * ((p[i] > p[j]) + (p[i] == p[j]) / 2) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0))
    n = w[y == 1].sum() * w[y == 0].sum()
    return won / n if n else np.nan


def test_weights_are_the_same_everywhere_and_poisson(spark):
    rows = spark.range(300).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(40)))).select("id", "rep", replicate_weight(F.col("id"), F.col("rep")).alias("w")).toPandas()
    table = rows.pivot(index="id", columns="rep", values="w").to_numpy()
    assert np.array_equal(table, weights(np.arange(300), np.arange(41)))
    w = weights(np.arange(3000), np.arange(200))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert np.abs(np.corrcoef(w.T) - np.eye(200)).max() < 0.1 and np.abs(np.corrcoef(w[:200]) - np.eye(200)).max() < 0.4


@pytest.mark.parametrize("scores", ["even", "crowded", "one", "ties"])
def test_replicate_aucs(spark, scores):
    rnd = np.random.default_rng(1)
    p = {"even": rnd.random(90), "crowded": rnd.random(90) ** 40, "one": np.full(90, 0.5), "ties": rnd.integers(0, 3, 90) / 7}[scores]
    y, key = rnd.integers(0, 2, 90), rnd.integers(0, 2, 90)
    y[key == 1] = 1 if scores == "ties" else y[key == 1]
    rows = [(i, str(k), float(a), int(b)) for i, k, a, b in zip(range(90), key, p, y, strict=True)] + [(5, "0", None, 1), (6, "0", 0.5, None), (None, "0", 0.5, 1)]
    df = spark.createDataFrame(rows, "id long, k string, p double, y int").repartition(5)
    w = weights(np.arange(90), np.arange(30))
    for r in replicate_aucs(df, ["k"], "id", 30, parts=8).collect():
        mine = key == int(r["k"])
        want = [area(p[mine], y[mine], w[mine, b]) for b in range(30)]
        got = np.array([np.nan if x is None else x for x in r["auc"]])
        assert np.allclose(got, want, equal_nan=True)
    assert bootstrap(df.filter("k = '0'"), ["k"], "id", 7).count() == 7
    assert bootstrap(df.limit(0), ["k"], "id", 7).count() == 0


def test_cells_in_chunks():
    rnd = np.random.default_rng(2)
    p, y, w = np.sort(rnd.integers(0, 9, 200) / 9), rnd.integers(0, 2, 200), rnd.integers(0, 4, (200, 5)).astype(float)
    cell = Cell(5)
    for lo in range(0, 200, 7):
        cell.add(p[lo : lo + 7], y[lo : lo + 7], w[lo : lo + 7])
    cell.close()
    assert np.allclose(cell.won / (cell.pos * cell.neg), [area(p, y, w[:, b]) for b in range(5)])


def test_bins_keep_order_and_spread_crowded_scores(spark):
    """99 % of the scores lie below 0.0001, and a tenth is one score."""
    rnd = np.random.default_rng(3)
    p = np.concatenate((rnd.random(8900) * 1e-4, np.full(1000, 5e-5), rnd.random(100)))
    df = spark.createDataFrame([(float(x),) for x in p], "p double").withColumn("k", F.lit(1))
    got = with_bins(df, ["k"], "p", 64).toPandas().sort_values("p")
    assert (np.diff(got["_bin"]) >= 0).all()
    sizes = got.groupby("_bin")["p"].agg(["size", "nunique"])
    assert (sizes["nunique"][sizes.index % 2 == 1] == 1).all() and sizes["size"][sizes.index % 2 == 0].max() < 500
    cuts = cut_points(df, ["k"], "p", 64).first()["_cuts"]
    assert all(len(g) <= 16 for g in cuts)
    flat = [c for g in cuts for c in g]
    x = spark.createDataFrame([(c,) for c in [*flat, *(c + 1e-12 for c in flat), -1.0, 2.0]], "p double").withColumn("_cuts", F.lit(cuts)).withColumn("_heads", F.lit([g[0] for g in cuts]))
    for r in x.select("p", bin_of(F.col("p")).alias("b")).collect():
        i = np.searchsorted(flat, r["p"])
        assert r["b"] % 2 == (r["p"] in flat) and r["b"] // 2 == i


def plain_trials(rows, sets, bags):
    """The experiment by its definition: areas of the drawn and of the other rows, for weights chosen on the drawn ones."""
    out = {}
    for (size, trial), ids in sets.items():
        for label in sorted({r[1] for r in rows}):
            mine = [r for r in rows if r[1] == label]
            i, y, r1, r2 = (np.array([r[k] for r in mine]) for k in (0, 2, 3, 4))
            sel = np.isin(i, list(ids))
            at = lambda w, s, rw=None: area(np.round((1 - w) * r1[s] + w * r2[s], 9), y[s], rw)  # noqa: E731, B023
            pick = lambda rw=None: next((g for g, a in zip(GRID, v, strict=True) if a == max(v)), 0.0) if not np.isnan((v := [np.round(at(g, sel, rw), 9) for g in GRID])[0]) else 0.0  # noqa: E731, B023
            w = pick()
            b = float(round(np.mean([pick(weights(i[sel], np.array([100_000 + trial * bags + k]))[:, 0]) for k in range(bags)]), 6)) if bags else 0.0
            out[size, trial, label] = (w, b, at(w, sel), at(0, sel), at(w, ~sel), at(0, ~sel), at(b, sel), at(b, ~sel))
    return out


def test_selection_trials(spark):
    rnd = np.random.default_rng(4)
    n = 60
    rows = [(int(i), label, int(y), float(np.round(a, 6)), float(np.round(b, 6))) for label in ("u", "v") for i, y, a, b in zip(range(n), rnd.random(n) < (0.4 if label == "u" else 0.08), rnd.permutation(n) / n, rnd.permutation(n) / n, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, label string, y int, r1 double, r2 double")
    chosen, sets = selection_trials(df, "doc_id", sizes=(7, 20, 500), trials=6, bags=3)
    drawn_ids = {}
    for r in sets.collect():
        drawn_ids.setdefault((r["size"], r["trial"]), set()).add(r["doc_id"])
    assert {k: len(v) for k, v in drawn_ids.items()} == {(s, t): s for s in (7, 20) for t in range(6)}
    want = plain_trials(rows, drawn_ids, 3)
    got = {(r["size"], r["trial"], r["label"]): r for r in chosen.collect()}
    assert set(got) == set(want)
    same = lambda a, b: (a is None and np.isnan(b)) or abs(a - b) < 1e-9
    for k, (w, b, *rest) in want.items():
        r = got[k]
        assert r["w"] == w and abs(r["w_bagged"] - b) < 1e-9, k
        assert all(same(r[c], x) for c, x in zip(("here", "here_0", "there", "there_0"), rest, strict=False)), k
    for r in score_chosen(df, "doc_id", chosen, sets, "w_bagged").collect():
        w = want[r["size"], r["trial"], r["label"]]
        assert same(r["here"], w[6]) and same(r["there"], w[7]) and same(r["here_0"], w[3]) and same(r["there_0"], w[5])
    table = optimism(chosen).collect()
    assert {r["size"] for r in table} == {7, 20} and all(r["claimed"] >= 0 and r["p_claimed_0100"] >= r["p_claimed_0273"] for r in table)


def test_drawn_takes_few_more_than_needed(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    d = drawn(df, "doc_id", 3, 50).toPandas()
    assert d.groupby("trial").size().tolist() == [50] * 3 and d["doc_id"].nunique() > 120
    assert drawn(df.limit(4), "doc_id", 2, 50).count() == 8
    assert choose("doc_id", GRID, 0).__name__ == "run"


def test_areas_of_crowded_scores_are_the_same_by_any_bins(spark):
    rnd = np.random.default_rng(6)
    rows = [(k, int(rnd.random() < 0.3), float(p)) for k in ("u", "v") for p in np.round(rnd.random(400) ** 30, 9)]
    df = spark.createDataFrame(rows, "k string, y int, p double")
    a, b = ({r["k"]: r["auc"] for r in auc(df, ["k"], **grid).collect()} for grid in ({}, {"parts": 16}))
    assert a == b and a["u"] == pytest.approx(area(np.array([r[2] for r in rows if r[0] == "u"]), np.array([r[1] for r in rows if r[0] == "u"])))


def test_drawn_sets_equal_the_formula(spark):
    from gradeloom.functions.resampling import uniform
    from gradeloom.operators.selection import TRIALS, drawn

    rows = spark.range(300).withColumnRenamed("id", "doc_id")
    got = {(r["trial"], r["place"]): r["doc_id"] for r in drawn(rows, "doc_id", 3, 20).collect()}
    want = {(t, i + 1): d for t in range(3) for i, d in enumerate(sorted(range(300), key=lambda d: (uniform(d, t + TRIALS), d))[:20])}
    assert got == want


def test_rows_in_order_join_nothing_back_by_score(spark):
    from gradeloom.operators.selection import placed_in_order

    rows = spark.createDataFrame([(i, "x", i % 2, round(i % 7 / 7, 9)) for i in range(60)], "id long, k string, y int, p double")
    out, whole = placed_in_order(rows, ["k"])
    all_rows = rows.collect()
    win = lambda r: sum((x["p"] < r["p"]) + (x["p"] == r["p"]) / 2 if r["y"] else (x["p"] > r["p"]) + (x["p"] == r["p"]) / 2 for x in all_rows if x["y"] != r["y"])
    assert {r["id"]: r["won"] for r in out.collect()} == {r["id"]: win(r) for r in all_rows}
    assert whole.first()["area"] == sum(win(r) for r in all_rows if r["y"])


def test_packed_orders_count_wins_at_any_weight(spark):
    """Rows at a weight are packed numbers of 4 bytes, not rows of a table; parts and scores outside of [0, 1] change no count."""
    from gradeloom.operators.selection import pack_rows, packed, score_keys, settle, unpacked

    rnd = np.random.default_rng(3)
    y, r1, r2 = (rnd.random(300) < 0.4).astype(int), np.round(rnd.random(300), 1), np.round(rnd.random(300) * 1.4 - 0.2, 1)
    at = np.array([0.0, 0.124, 1.0])
    cells = pd.concat(pack_rows({"u": at}, {"u": 3})(iter([pd.DataFrame({"label": "u", "y": y, "r1": r1, "r2": r2})])))
    assert all(len(d) == 1 + (4 if d[0] == 4 else 8) * len(unpacked([d])) for d in cells["data"]) and set(cells.query("g == 0")["data"].map(lambda d: d[0])) == {4}
    for g, w in enumerate(at):
        k, own, base, got = score_keys(r1, r2, w), np.arange(300) % 10 == 0, 0, 0.0
        asked = {b: d for b, d in packed(k[own], y[own], 3)}
        won = np.array([(((k < k[i]) if y[i] else (k > k[i])) + (k == k[i]) / 2)[y != y[i]].sum() for i in np.flatnonzero(own)])
        pos_below = neg_below = 0
        for b, part in sorted(cells[cells["g"] == g].groupby("part")):
            rows = pd.concat([part.assign(size=None, trial=None), pd.DataFrame([("u", g, b, asked[b], 7, 1)], columns=["label", "g", "part", "data", "size", "trial"])] if b in asked else [part.assign(size=None, trial=None)])
            whole, *sets = settle(rows).itertuples(index=False)
            base += whole.won + whole.pos * neg_below
            got += sum(s.won + s.pos * neg_below + s.neg * (y.sum() - pos_below) for s in sets)
            pos_below, neg_below = pos_below + whole.pos, neg_below + whole.neg
        assert got == won.sum() and abs(base / (y.sum() * (1 - y).sum()) - area(k, y)) < 1e-12
