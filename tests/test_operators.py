"""Traps and properties of the operators on small frames."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.metrics import auc, balanced_accuracy, macro
from gradeloom.functions.ranks import corr, ranked
from gradeloom.operators import metadata as m
from gradeloom.operators.folds import assign_folds, fold_report
from gradeloom.plans.table_queries import sanitise
from gradeloom.plans.window_queries import allocation, fill_nearest, first_by_hash
from gradeloom.sources.tables import MissingColumns, registry, require


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def brute_auc(rows):
    pos, neg = [p for y, p in rows if y == 1], [p for y, p in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auc_with_ties_and_out_of_range_scores(spark):
    rnd = random.Random(1)
    rows = [("x", rnd.randint(0, 1), rnd.choice([-3.0, 0.1, 0.1001, 0.5, 0.9, 7.0]) + rnd.choice([0, rnd.random()])) for _ in range(300)]
    rows += [("one", 1, 0.5), ("one", 1, 0.2), ("x", None, 0.5), ("x", 1, None)]
    got = {r["k"]: r["auc"] for r in auc(frame(spark, rows, "k string, y int, p double"), ["k"]).collect()}
    assert got["one"] is None and abs(got["x"] - brute_auc([(y, p) for k, y, p in rows if k == "x" and y is not None and p is not None])) < 1e-12


def test_auc_of_a_binary_score_is_balanced_accuracy_and_monotone(spark):
    rnd = random.Random(2)
    df = frame(spark, [(rnd.randint(0, 1), float(rnd.randint(0, 1)), rnd.random()) for _ in range(200)], "y int, b double, p double").withColumn("k", F.lit(1))
    a = auc(df, ["k"], "b").first()["auc"]
    assert abs(a - df.agg(balanced_accuracy(F.col("y"), F.col("b"))).first()[0]) < 1e-12
    bent = df.withColumn("q", F.col("p") ** 3 / 2)
    assert auc(df, ["k"]).first()["auc"] == auc(bent, ["k"], "q").first()["auc"]


def test_macro_skips_labels_of_one_class(spark):
    df = frame(spark, [("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.2)], "label string, y int, p double").withColumn("arm", F.lit("z"))
    assert tuple(macro(auc(df, ["arm", "label"]), ["arm"]).first()) == ("z", 1.0, 1)


def test_average_ranks(spark):
    df = frame(spark, [("g", v) for v in (3.0, 1.0, 3.0, 2.0, None)], "k string, p double")
    got = sorted((r["p"], r["avg_rank"], r["pct_rank"]) for r in ranked(df, ["k"], "p").collect())
    assert got == [(1.0, 1.0, 0.25), (2.0, 2.0, 0.5), (3.0, 3.5, 0.875), (3.0, 3.5, 0.875)]


def test_correlation_of_a_constant_is_null(spark):
    assert frame(spark, [(1.0, 2.0), (1.0, 3.0)], "a double, b double").agg(corr("a", "b")).first()[0] is None


def test_missing_values(spark):
    df = frame(spark, [(float("nan"),), (None,), (2.0,), (-1.0,), (0.25,)], "p double")
    assert [r[0] for r in df.select(sanitise(F.col("p"))).collect()] == [0.5, 0.5, 1.0, 0.0, 0.25]
    side, origin = m.side(F.col("t"), F.col("x"))
    got = frame(spark, [("R", 1.0), (" ", -70.0), (None, float("nan")), ("", None), (None, -62.0)], "t string, x double").select(side, origin).collect()
    assert [tuple(r) for r in got] == [("R", "tag"), ("R", "geometry"), (None, "none"), (None, "none"), ("L", "geometry")]


def test_exact_option_tokens_and_null_times(spark):
    df = frame(spark, [("SAT_GEMS|PFP", None), ("x| fs ", 900.0)], "o string, tr double")
    got = df.select(m.token_in(F.col("o"), "FS"), m.weighting(F.lit("loc"), F.lit("SE"), F.col("tr"), F.lit(None).cast("double"))).collect()
    assert [tuple(r) for r in got] == [(False, "UNK"), (True, "PD")]


def test_fingerprint_writes_null_as_na(spark):
    df = frame(spark, [(1, "a", None, 1.0), (1, "b", None, 2.0), (2, None, "z", None)], "k int, c string, d string, n double")
    got = {r["k"]: r["fingerprint"] for r in m.fingerprint(df, "k", ["c", "d"], "n").collect()}
    assert got == {1: "a|NA|1.500", 2: "NA|z|NA"}


def test_completeness(spark):
    s = frame(spark, [(1,), (1,), (2,), (3,), (3,)], "k int")
    t = frame(spark, [(1,), (1,), (3,)], "k int")
    assert {r["k"]: r["action"] for r in m.completeness(s, t, "k").collect()} == {1: "skip", 2: "new", 3: "rebuild"}


def test_fill_nearest_prefers_the_earlier(spark):
    df = frame(spark, [(1, 0, None), (1, 1, "a"), (1, 2, None), (1, 3, "b"), (2, 0, None)], "k int, i int, x string")
    got = {(r["k"], r["i"]): r["filled"] for r in fill_nearest(df, ["k"], "i", "x").collect()}
    assert got == {(1, 0): "a", (1, 1): "a", (1, 2): "a", (1, 3): "b", (2, 0): None}


def test_allocation_and_draw(spark):
    df = frame(spark, [("en", 5000), ("fr", 100), ("de", 49), ("es", 60)], "lang string, avail long")
    got = {r["lang"]: r["take"] for r in allocation(df, 250, capped="en").collect()}
    assert got == {"en": 60, "fr": 20, "de": 2, "es": 20}
    rows = frame(spark, [(i, i % 2) for i in range(500)], "id long, g int")
    draw = first_by_hash(rows, "id", ["g"], 3, F.lit(7)).collect()
    assert len(draw) == 14 and {r["id"] for r in draw} == {r["id"] for r in first_by_hash(rows.repartition(7), "id", ["g"], 3, F.lit(7)).collect()}


def test_folds_are_atomic_and_balanced(spark):
    rnd = random.Random(5)
    groups = [(f"g{i}", n := (1 if i % 3 else rnd.randint(1, 40)), rnd.randint(0, n), rnd.randint(0, n) // 3) for i in range(1500)]
    df = frame(spark, groups, "grp string, n int, a int, b int")
    folds = {r["grp"]: r["fold"] for r in assign_folds(df, "grp", "n", ["a", "b"]).collect()}
    assert len(folds) == len(groups) and set(folds.values()) == set(range(5))
    for c in (1, 2, 3):
        total = sum(g[c] for g in groups)
        share = [sum(g[c] for g in groups if folds[g[0]] == k) / total for k in range(5)]
        assert math.sqrt(sum((s - 0.2) ** 2 for s in share) / 5) < 0.004
    rows = frame(spark, [("x", 0, 1), ("x", 1, 0), ("y", 1, 1)], "grp string, fold int, a int")
    assert {r["fold"]: (r["n"], r["split"]) for r in fold_report(rows, "fold", "grp", ["a"]).collect()} == {0: (1, 1), 1: (2, 1)}


def test_schema_checks(spark):
    df = frame(spark, [(1, 2)], "a int, b int")
    with pytest.raises(MissingColumns):
        require(df, "a", "z")
    with pytest.raises(MissingColumns):
        registry({"x": df}, ["z"])
    assert registry({"x": df, "y": df.drop("b")}, ["a", "b"]).count() == 1


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    from gradeloom.sources.tables import blank_to_null, nan_to_null, read_csv, to_long, to_wide

    (tmp_path / "r.csv").write_text('id,report,y\n1,"two\nlines, ""quoted""",0.5\n2, ,NaN\n3,,\n')
    df = read_csv(spark, str(tmp_path / "r.csv"), "id int, report string, y double")
    got = {r["id"]: (r["t"], r["y"]) for r in df.select("id", blank_to_null(F.col("report")).alias("t"), nan_to_null(F.col("y")).alias("y")).collect()}
    assert got == {1: ('two\nlines, "quoted"', 0.5), 2: (None, None), 3: (None, None)}
    wide = frame(spark, [(1, 0.1, 0.2), (2, None, 0.4)], "id int, a double, b double")
    assert sorted(map(tuple, to_wide(to_long(wide, ["id"], ["a", "b"]), ["id"], ["a", "b"], value="y").collect())) == [(1, 0.1, 0.2), (2, None, 0.4)]


def test_written_csv_keeps_every_text(spark):
    from gradeloom.sources.tables import read_written_csv, write_csv

    texts = [None, "", " ", "\\N", "\\", "\\b", "\\0", 'a"\0"b', "\0", '"', "\r\n", "a\rb", '",\n"', " a ", "\ufeff#"]
    rows = [(i, t, u) for i, (t, u) in enumerate((t, u) for t in texts for u in texts)] + [(None, "x", None)]
    df = frame(spark, rows, "i int, t string, u string")
    assert set(map(tuple, read_written_csv(spark, write_csv(df), df.schema).collect())) == set(rows)


def test_numbers_within_ranges(spark):
    from gradeloom.functions.ranks import numbered

    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 5, 7, rnd.randint(0, 10**6), -3, 2 * 10**6])) for i in range(2000)]
    got = numbered(frame(spark, rows, "i int, v long"), F.col("v"), ["i"], 0, 10**6).select("i", "_n").collect()
    assert [i for i, _ in sorted(map(tuple, got), key=lambda r: r[1])] == [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))] and sorted(r[1] for r in got) == list(range(2000))


def test_long_rest_of_folds_is_dealt(spark):
    groups = [(f"g{i}", i % 50 + 1, *(i * p % 7 for p in (3, 5, 11, 13))) for i in range(600)]
    df = frame(spark, groups, "grp string, n int, a int, b int, c int, d int")
    folds = {r["grp"]: r["fold"] for r in assign_folds(df, "grp", "n", list("abcd"), most=10).collect()}
    assert len(folds) == 600 and all(110 <= list(folds.values()).count(k) <= 130 for k in range(5))


def test_out_of_fold_baseline(spark):
    from gradeloom.operators.baseline import out_of_fold

    rnd = random.Random(3)
    rows = [(i, x := rnd.random(), rnd.random(), int(x > 0.5), int(i < 3), None if i % 2 else int(rnd.random() < 0.5)) for i in range(200)]
    df = frame(spark, rows, "id long, x double, z double, known int, rare int, noise int")
    got = {r["label"]: r for r in out_of_fold(df, "id", ["known", "rare", "noise"], ["x", "z"]).collect()}
    assert got["known"]["auc"] > 0.97 and got["rare"]["auc"] is None and got["rare"]["n_pos"] == 3 and abs(got["noise"]["auc"] - 0.5) < 0.2
    assert got["noise"]["n_pos"] + got["noise"]["n_neg"] == 100


def test_spans_of_stems(spark):
    from gradeloom.operators.text import spans

    df = frame(spark, [("anand ion an", ), ("", ), ("aaa.", ), ("ionion", )], "t string")
    got = [[tuple(x) for x in r[0]] for r in df.select(spans(F.col("t"), ["an", "ion", "aa", "."])).collect()]
    assert got == [[(1, 3), (3, 5), (7, 10), (11, 13)], [], [(1, 3), (2, 4), (4, 5)], [(1, 4), (4, 7)]]


def test_trigrams_of_a_long_text_come_from_one_search(spark):
    from gradeloom.operators.glossary import grams

    df = spark.createDataFrame([("é𝒳ab" * 150_000,), ("ab",), ("",), ("a\nb",)], "c string")
    began = time.time()
    got = [sorted(r["g"]) for r in df.select(grams(F.col("c"), 3).alias("g")).collect()]
    assert got == [sorted(["é𝒳a", "𝒳ab", "abé", "bé𝒳"]), [], [], ["a\nb"]] and time.time() - began < 60
