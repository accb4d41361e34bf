"""A glossary as a table: hundreds of stems or many more, matched against clauses by an index of rare trigrams, and rules over the keys that a clause holds.

A term is one stem or several joined by ``~``, which must all occur; a part that begins with ``^`` must begin a word. Each term is known by the trigram of its parts that the fewest clauses hold.
A clause is joined with the terms of its language that are known by one of its trigrams, and only these are looked for in it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, written
from .text import normalize

NESTED = "map<string, map<string, array<string>>>"
RULE_SCHEMA = "rule string, requires array<string>, forbids array<string>, emits array<string>, state string, unsure string, negated string"


def read_glossary(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("findings", "cues")) -> DataFrame:
    """kind, key, lang, stem from JSON, over as many lines as it likes: kind -> key -> language -> stems. Other members of the file are ignored; a kind that is missing has no rows."""
    j = spark.read.schema(", ".join(f"{k} {NESTED}" for k in kinds)).json(path, multiLine=True)
    rows = j.select(F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))])).alias("kind", "keys")).select("kind", F.explode("keys").alias("key", "langs"))
    return rows.select("kind", "key", F.explode("langs").alias("lang", "stems")).select("kind", "key", "lang", F.explode("stems").alias("stem"))


def write_glossary(rows: DataFrame, path: str | None = None) -> str:
    """Write kind, key, lang, stem (a table that fits one JSON object) as read_glossary reads it; returns the path."""
    path = path or f"{shared_folder(rows.sparkSession)}/glossary-{uuid.uuid4().hex}"
    one = rows.groupBy("kind", "key", "lang").agg(F.array_sort(F.collect_set("stem")).alias("stems"))
    for key, value in (("lang", "stems"), ("key", "m"), ("kind", "m")):
        rest = [c for c in ("kind", "key", "lang") if c in one.columns and c != key]
        one = one.groupBy(*rest).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
    one.select(F.to_json("m", {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)
    return path


def grams(text: Column, n: int) -> Column:
    """The different runs of n letters; none if the text is shorter. One search that steps from letter to letter: cutting each run out by its place would go through the text anew for every place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1)))


def terms_of(glossary: DataFrame) -> DataFrame:
    """key, lang, parts (text, and whether it begins a word) and every part's trigrams (a shorter part is its own), of normalised terms."""
    parts = F.filter(F.transform(F.split(normalize(F.col("stem")), "~"), lambda p: F.struct(F.regexp_replace(p, r"^\^", "").alias("text"), p.startswith("^").alias("starts"))), lambda p: p["text"] != "")
    rows = glossary.select("key", "lang", parts.alias("parts")).filter(F.size("parts") > 0).distinct()
    three = F.flatten(F.transform("parts", lambda p: F.when(F.length(p["text"]) < 3, F.array(p["text"])).otherwise(grams(p["text"], 3))))
    return rows.withColumns({"term": F.xxhash64("key", "lang", "parts"), "grams": F.array_distinct(three)})


def holds(clause: Column, parts: Column) -> Column:
    """Whether the clause has all parts; those that begin a word have no letter before them."""

    def starts(text: Column) -> Column:
        quoted = F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
        return F.regexp(clause, F.concat(F.lit(r"(?<!\p{L})\Q"), quoted, F.lit(r"\E")))

    return F.forall(parts, lambda p: F.when(p["starts"], starts(p["text"])).otherwise(F.contains(clause, p["text"])))


def glossary_hits(clauses: DataFrame, glossary: DataFrame, keys: list[str], few: int = 500_000) -> DataFrame:
    """keys and key, once each, for every clause (columns keys, among them lang, and clause, normalised) that holds a term of its language.

    Null clauses or languages hold none. The index is broadcast up to ``few`` counted terms; a larger one is joined by trigrams, and clauses come back to their candidates for the last look.
    """
    terms = written(terms_of(glossary))
    sizes = sorted(r[0] for r in terms.select(F.explode(F.transform("grams", lambda g: F.length(g))).alias("n")).distinct().collect())  # 1 to 3
    small = terms.count() <= few
    near = lambda df: F.broadcast(df) if small else df
    rows = clauses.filter(F.col("clause").isNotNull() & F.col("lang").isNotNull())
    every = F.concat(*[grams(F.col("clause"), n) for n in sizes]) if sizes else F.array().cast("array<string>")
    wanted = terms.select("lang", F.explode("grams").alias("gram")).distinct()
    counts = rows.select("lang", F.explode(every).alias("gram")).join(near(wanted), ["lang", "gram"]).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    known = terms.select("term", "lang", F.explode("grams").alias("gram")).join(near(counts), ["lang", "gram"])  # a trigram that no clause holds rules its term out
    rare = known.groupBy("term", "lang").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("held"))
    index = written(terms.join(rare, ["term", "lang"]).filter(F.col("held") == F.size("grams")).select("lang", "gram", "key", "parts"))
    if small:
        found = rows.select(*keys, "clause", F.explode(every).alias("gram")).join(F.broadcast(index), ["lang", "gram"])
    else:
        found = rows.select(*keys, F.explode(every).alias("gram")).join(index, ["lang", "gram"]).drop("gram").join(rows.select(*keys, "clause"), keys)
    return found.filter(holds(F.col("clause"), F.col("parts"))).select(*keys, "key").distinct()


def apply_rules(sets: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule, label, state: what each rule of the table emits for each row of sets (keys, the array ``keys`` of glossary keys, negated_clause and uncertain).

    A rule applies if all keys that it requires (one at least) and none that it forbids are there; its state is that for negated clauses, for uncertain ones, or the plain one, and where that is null it does not
    apply. Rows meet rules by the first required key, so rules are not tried on rows that can't fulfil them.
    """
    first = rules.withColumn("_key", F.try_element_at("requires", F.lit(1)))
    met = sets.withColumn("_key", F.explode("keys")).join(F.broadcast(first), "_key")  # rules are written by hand
    met = met.filter((F.size(F.array_except("requires", "keys")) == 0) & ~F.arrays_overlap("forbids", "keys"))
    out = F.when(F.col("negated_clause"), F.col("negated")).when(F.col("uncertain"), F.col("unsure")).otherwise(F.col("state"))
    return met.select(*keys, "rule", F.explode("emits").alias("label"), out.alias("state")).filter(F.col("state").isNotNull())
