import time
import unicodedata

from pyspark.sql import functions as F

from gradeloom.operators import text as t


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first()["x"]


def test_normalize_keeps_length_and_drops_marks(spark):
    for s in ("École ÉTÉ", "İstanbul ı µ ς", "Straße Ñandú", "ÄÖÜ äöü ǆ ǅ", "plain"):
        got = one(spark, t.normalize(F.col("c")), c=s)
        assert len(got) == len(s)
        for a, b in zip(s, got, strict=True):
            if a not in "İıµς":
                assert b == (unicodedata.normalize("NFKD", a.lower())[0] if ord(a) <= 0x24F else a.lower()), (a, b)
    assert one(spark, t.normalize_hard(F.col("c")), c=" Straße_Öl-  ab/c\\d ") == "strasse ol ab c d"


def test_word_start_and_conjunction(spark):
    assert not one(spark, F.col("c").rlike(t.pattern(["normal"], True)), c="abnormal été")
    assert one(spark, F.col("c").rlike(t.pattern(["normal"], True)), c="it is normal")
    assert one(spark, F.col("c").rlike(t.pattern(["normal"], False)), c="abnormal")
    assert one(spark, t.has_all(F.col("c"), "a~b"), c="b a") and not one(spark, t.has_all(F.col("c"), "a~b"), c="a c")


def test_heading_is_merged_with_the_next_clause(spark):
    df = spark.createDataFrame([(1, "Fractures :\nAucune. Fin"), (2, ", ".join(f"w{i} w w w" for i in range(9)))], "id int, text string")
    rows = t.merged_clauses(df, ["id"]).orderBy("id", "pos", "part").collect()
    assert [r["clause"] for r in rows if r["id"] == 1] == ["fractures : aucune.", "fin"]
    assert len([r for r in rows if r["id"] == 2]) == 10


def test_spans_distance_and_greedy(spark):
    s = lambda *stems: t.spans(F.col("c"), list(stems))
    assert [(x["s"], x["e"]) for x in one(spark, s("ana"), c="banana")] == [(2, 5), (4, 7)]
    assert [(x["s"], x["e"]) for x in one(spark, t.greedy(s("an", "ana")), c="banana")] == [(2, 5)]
    assert one(spark, t.distance(s("left"), s("knee")), c="left  knee") == 2
    assert one(spark, t.distance(s("ab"), s("bc")), c="abc") == 0 and one(spark, t.distance(s("x"), s("a")), c="a") is None


def test_highest_state_first_clause(spark):
    df = spark.createDataFrame([(1, 0, "neg", "n"), (1, 1, "pos", "first"), (1, 2, "pos", "second"), (2, 0, "weak", "w" * 300)], "id int, pos int, state string, clause string")
    got = {r["id"]: (r["state"], r["evidence"]) for r in t.fold_states(df, ["id"]).collect()}
    assert got == {1: ("pos", "first"), 2: ("weak", "w" * 220)}


def test_spans_and_distance_take_time_in_proportion_to_a_long_clause(spark):
    df = spark.createDataFrame([("the and ing ion " * 4_000,)], "c string")
    s = lambda *stems: t.spans(F.col("c"), list(stems))
    began = time.time()
    got = df.select(F.size(s("and", "an", "ion")).alias("n"), t.distance(s("the"), s("ing")).alias("gap"), F.size(t.greedy(s("and", "an"))).alias("kept")).first()
    assert tuple(got) == (12_000, 5, 4_000) and time.time() - began < 60
