"""Two-phase output, SQL functions and the glossary table."""

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.sql_functions import register_scalars
from gradeloom.operators import text as t
from gradeloom.operators.glossary import RULE_SCHEMA, apply_rules, glossary_hits, read_glossary, write_glossary
from gradeloom.sources.publish import CheckFailed, current_version, problems, publish, publish_default, read_current


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_failing_replacement_leaves_what_was_there(spark, tmp_path):
    ids, root = spark.range(3).withColumnRenamed("id", "k"), f"{tmp_path}/out"
    assert current_version(spark, root) is None
    publish_default(ids, root, "k", ["a", "b"])
    default = [(0, 0.5, 0.5), (1, 0.5, 0.5), (2, 0.5, 0.5)]
    assert values(read_current(spark, root)) == default
    frame = lambda rows, names="k long, a double, b double": spark.createDataFrame(rows, names)
    whole = [(0, 0.1, 0.2), (1, 0.0, 1.0), (2, 0.3, 0.4)]
    for rows, names, word in (
        (whole[:2], "k long, a double, b double", "1 ids that lack"), ([*whole, (9, 0.1, 0.1)], "k long, a double, b double", "1 unknown ids"), ([*whole, whole[0]], "k long, a double, b double", "occur twice"),
        ([*whole[:2], (2, None, 0.1)], "k long, a double, b double", "1 nulls in a"), ([*whole[:2], (2, float("nan"), 0.1)], "k long, a double, b double", "1 nulls in a"),
        ([*whole[:2], (2, 0.1, 1.5)], "k long, a double, b double", "1 values of b out of"), (whole, "k long, b double, a double", "columns are"),
    ):
        with pytest.raises(CheckFailed, match=word):
            publish(frame(rows, names), root, ids, "k", ["a", "b"])
        assert values(read_current(spark, root)) == default
    first = current_version(spark, root)
    version = publish(frame(whole), root, ids, "k", ["a", "b"])
    assert current_version(spark, root) == version != first and values(read_current(spark, root)) == whole
    assert problems(frame(whole), ids, "k", ["a", "b"]) == []


def test_scalar_functions(spark):
    register_scalars(spark)
    row = spark.sql("SELECT rank_auc(7, 2, 3) AS a, rank_auc(7, 0, 3) AS none, pct_rank(2, 2, 8) AS r, wilson(0, 10) AS w").first()
    assert row["a"] == pytest.approx(4 / 6) and row["none"] is None and row["r"] == pytest.approx(3.5 / 8)
    assert row["w"]["low"] == 0 and row["w"]["high"] == pytest.approx(0.277540, abs=1e-5)


GLOSSARY = [("findings", "acl", "en", "cruciate~anterior"), ("findings", "acl", "en", "acl"), ("findings", "oa", "en", "^chondral"), ("findings", "oa", "de", "arthrös"), ("findings", "odd", "en", "a.b"), ("findings", "short", "en", "^of"), ("cues", "neg", "en", "no")]


def test_glossary_file_and_matches(spark, tmp_path):
    rows = spark.createDataFrame(GLOSSARY, "kind string, key string, lang string, stem string")
    path = write_glossary(rows, f"{tmp_path}/g")
    text = "".join(r["value"] + "\n" for r in spark.read.text(path).collect())
    assert text.count("\n") > 10  # over many lines
    back = read_glossary(spark, path)
    assert values(back) == sorted(GLOSSARY, key=str)
    texts = ["anterior part of the Cruciate", "cruciate only", "subchondral", "a chondral one", "ARTHRÖSE", "axb a.b", "often", None, "", "x"]
    docs = spark.createDataFrame([(i, lang, x) for i, x in enumerate(texts) for lang in ("en", "de", None)], "id int, lang string, raw string")
    clauses = docs.withColumn("clause", t.normalize(F.col("raw")))
    want = {(0, "en", "acl"), (0, "en", "short"), (3, "en", "oa"), (4, "de", "oa"), (5, "en", "odd"), (6, "en", "short")}
    for few in (500_000, 0):
        got = glossary_hits(clauses, back.filter("kind = 'findings'"), ["id", "lang"], few=few)
        assert {tuple(r) for r in got.collect()} == want
    assert glossary_hits(clauses, back.limit(0), ["id", "lang"]).count() == 0


def test_glossary_equals_the_alternation(spark):
    stems = {"en": ["ing", "^th", "ation", "ß"], "de": ["ung", "keit", "^ver"]}
    rows = spark.createDataFrame([("findings", "k", lang, s) for lang, x in stems.items() for s in x], "kind string, key string, lang string, stem string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clauses = t.clauses(docs, ["doc_id", "lang"])
    by_join = {tuple(r) for r in glossary_hits(clauses, rows, ["doc_id", "lang", "pos"]).select("doc_id", "pos").collect()}
    by_pattern = {tuple(r) for r in clauses.filter(t.has(F.col("clause"), F.col("lang"), stems)).select("doc_id", "pos").collect()}
    assert by_join == by_pattern and len(by_join) > 100


def test_rules_are_a_table(spark):
    sets = spark.createDataFrame([(1, ["a", "b"], False, False), (2, ["a", "b"], True, False), (3, ["a"], False, True), (4, ["a", "c"], False, False), (5, [], False, False)], "id int, keys array<string>, negated_clause boolean, uncertain boolean")
    rules = spark.createDataFrame([("both", ["a", "b"], ["c"], ["x", "y"], "weak", "weak", "neg"), ("one", ["a"], ["c"], ["z"], "pos", "hedged", None), ("never", [], [], ["q"], "pos", "pos", "pos")], RULE_SCHEMA)
    got = {tuple(r) for r in apply_rules(sets, rules, ["id"]).collect()}
    assert got == {(1, "both", "x", "weak"), (1, "both", "y", "weak"), (1, "one", "z", "pos"), (2, "both", "x", "neg"), (2, "both", "y", "neg"), (3, "one", "z", "hedged")}
    other = spark.createDataFrame([("c", ["c"], [], ["x"], "pos", "pos", "neg")], RULE_SCHEMA)
    assert {tuple(r) for r in apply_rules(sets, other, ["id"]).collect()} == {(4, "c", "x", "pos")}


def test_clauses_end_at_dashes_and_bullets_between_blanks(spark):
    df = spark.createDataFrame([(1, "Été - l'eau • fin\nnon-stop – A.B;  ; x")], "id int, text string")
    rows = [(r["raw"], r["clause"]) for r in t.clauses(df, ["id"]).orderBy("pos").collect()]
    assert rows == [("Été", "ete"), ("l'eau", "l'eau"), ("fin", "fin"), ("non-stop", "non-stop"), ("A", "a"), ("B", "b"), (" x", " x")]


def test_sections_are_carried_until_a_heading_or_a_rule(spark):
    clauses = ["before", "Bones:", "one", "two", "-----", "three", "Knee :", "four"]
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(clauses)], "id int, pos int, clause string")
    got = [r["section"] for r in t.sections(df, ["id"]).orderBy("pos").collect()]
    assert got == [None, None, "Bones:", "Bones:", "Bones:", None, None, "Knee :"]
    x = spark.range(1).select(*[t.in_context(F.lit(w), F.lit(p), F.lit(b)).alias(f"c{i}") for i, (w, p, b) in enumerate([(1.0, True, False), (0.75, False, True), (1.0, False, True), (1.0, True, True)])]).first()
    assert [round(v, 6) for v in x] == [0.45, 1.0, 1.0, 0.6075]
