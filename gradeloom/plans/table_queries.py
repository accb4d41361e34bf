"""Projections, predicates, joins and aggregations over label, source and child tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ranks import corr
from ..sources.tables import table, to_long
from .base import GOLD, SCORED, documents, gold, query, scored
from .metric_queries import errors, r6

SPLIT = "CASE WHEN doc_id % 3 = 0 THEN 'x' WHEN doc_id % 3 = 1 THEN 'y' ELSE 'z' END"


@query("prj1_gold_flags", "SELECT count(*) AS n, count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL) AS n_all, count(*) FILTER (quality IS NOT NULL OR toxic IS NOT NULL) AS n_any, count(*) FILTER (quality IS NULL AND toxic IS NULL) AS n_none FROM documents LEFT JOIN labels USING (doc_id)")
def prj1(spark, d):
    j = documents(spark, d).select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    q, t = F.col("quality").isNotNull(), F.col("toxic").isNotNull()
    return j.agg(F.count("*").alias("n"), F.count_if(q & t).alias("n_all"), F.count_if(q | t).alias("n_any"), F.count_if(~q & ~t).alias("n_none"))


@query("prj2_drop_null_labels", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def prj2(spark, d):
    return documents(spark, d).select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").na.drop("any", subset=["quality", "toxic"])


@query("prj3_non_blank", "SELECT lang, count(*) AS n FROM documents WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY lang")
def prj3(spark, d):
    return documents(spark, d).filter(F.trim("text") != "").groupBy("lang").agg(F.count("*").alias("n"))


@query("prj4_binarise", f"WITH {SCORED} SELECT arm, label, count(*) FILTER (p > 0.5) AS strict, count(*) FILTER (p >= 0.5) AS inclusive FROM scored GROUP BY ALL")
def prj4(spark, d):
    return scored(spark, d).groupBy("arm", "label").agg(F.count_if(F.col("p") > 0.5).alias("strict"), F.count_if(F.col("p") >= 0.5).alias("inclusive"))


@query("prj5_domains", "SELECT count(DISTINCT lang) AS langs, count(*) FILTER (trim(text) = '') AS blank, count(*) FILTER (length(text) > 5000) AS too_long FROM documents")
def prj5(spark, d):
    return documents(spark, d).agg(F.countDistinct("lang").alias("langs"), F.count_if(F.trim("text") == "").alias("blank"), F.count_if(F.length("text") > 5000).alias("too_long"))


@query("prj6_composite_category", "SELECT lang || '_' || CASE WHEN n_chars % 2 = 1 THEN 'FS' ELSE 'nonFS' END AS combo, count(*) AS n FROM documents GROUP BY 1")
def prj6(spark, d):
    combo = F.concat_ws("_", "lang", F.when(F.col("n_chars") % 2 == 1, "FS").otherwise("nonFS"))
    return documents(spark, d).groupBy(combo.alias("combo")).agg(F.count("*").alias("n"))


@query("prj7_pair_code", "SELECT event_id, CASE WHEN user_id % 4 - 1 < 0 OR event_id % 3 - 1 < 0 THEN -1 ELSE (user_id % 4 - 1) * 2 + event_id % 3 - 1 END AS code FROM events")
def prj7(spark, d):
    p, f = F.col("user_id") % 4 - 1, F.col("event_id") % 3 - 1
    return table(spark, d, "events").select("event_id", F.when((p < 0) | (f < 0), F.lit(-1).cast("long")).otherwise(p * 2 + f).alias("code"))


@query("prj8_sample_weight", f"WITH {SCORED} SELECT doc_id, label, round(CASE WHEN doc_id % 10 = 0 THEN 3.0 ELSE 0.25 + 0.75 * abs(2 * p - 1) END, 9) AS w FROM scored WHERE arm = 'a'")
def prj8(spark, d):
    w = F.when(F.col("doc_id") % 10 == 0, 3.0).otherwise(0.25 + 0.75 * F.abs(2 * F.col("p") - 1))
    return scored(spark, d).filter("arm = 'a'").select("doc_id", "label", F.round(w, 9).alias("w"))


@query("prj9_coerce", "SELECT event_type, count(*) AS n, count(TRY_CAST(x AS DOUBLE)) AS n_numeric, round(sum(TRY_CAST(x AS DOUBLE)), 4) AS total FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS x FROM events) GROUP BY 1")
def prj9(spark, d):
    x = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 11 == 0, "").otherwise(F.col("user_id").cast("string"))
    v = x.try_cast("double")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(v).alias("n_numeric"), F.round(F.sum(v), 4).alias("total"))


@query("prj10_shards", "SELECT c_custkey % 8 AS shard, count(*) AS n, min(c_custkey) AS first_key FROM customer GROUP BY 1")
def prj10(spark, d):
    return table(spark, d, "customer").groupBy(F.pmod("c_custkey", F.lit(8)).alias("shard")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


@query("prj11_dirty_categories", "SELECT event_type, count(*) AS n, count(*) >= 0.05 * (SELECT count(*) FROM events) AS routable FROM events GROUP BY 1")
def prj11(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = F.broadcast(c.agg(F.sum("n").alias("total")))
    return c.join(total).select("event_type", "n", (F.col("n") >= 0.05 * F.col("total")).alias("routable"))


@query("prj12_fill_undecided", "SELECT doc_id, coalesce(quality, 0.5)::DOUBLE AS quality, coalesce(toxic, 0.5)::DOUBLE AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def prj12(spark, d):
    j = documents(spark, d).select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.5)).alias(c) for c in ("quality", "toxic")])


@query("prj13_full_coverage", "WITH a AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1), p AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events WHERE value > 20 GROUP BY 1) SELECT user_id, a.n AS slots FROM a JOIN p USING (user_id) WHERE a.n = p.n")
def prj13(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("slots"), F.countDistinct(F.when(F.col("value") > 20, F.col("event_type"))).alias("present"))
    return e.filter("slots = present").select("user_id", "slots")


@query("prj14_distribution_gate", f"WITH {SCORED} SELECT arm, avg(p) BETWEEN 0.3 AND 0.7 AND count(*) FILTER (isnan(p)) = 0 AS usable, round(stddev_pop(p), 6) AS sd FROM scored GROUP BY arm")
def prj14(spark, d):
    return scored(spark, d).groupBy("arm").agg((F.avg("p").between(0.3, 0.7) & (F.count_if(F.isnan("p")) == 0)).alias("usable"), r6(F.stddev_pop("p")).alias("sd"))


@query("prj15_sanitise", f"WITH {SCORED} SELECT arm, round(avg(least(1.0, greatest(0.0, coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE p * 1.4 - 0.2 END, 0.5)))), 6) AS mean FROM scored GROUP BY arm")
def prj15(spark, d):
    raw = F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p") * 1.4 - 0.2)
    return scored(spark, d).groupBy("arm").agg(r6(F.avg(sanitise(raw))).alias("mean"))


def sanitise(p):
    """NaN and null become 0.5; the rest is cut to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(p, F.lit(None).cast("double")), F.lit(0.5))))


@query("join1_inner", "SELECT d.doc_id, lang, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def join1(spark, d):
    return table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id")


@query("join2_left_coverage", "SELECT lang, count(*) AS n, count(quality) AS covered, round(count(quality)::DOUBLE / count(*), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def join2(spark, d):
    j = table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("covered"), r6(F.count("quality") / F.count("*")).alias("coverage"))


@query("join3_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join3(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment").filter("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders", "o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("join4_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join4(spark, d):
    return table(spark, d, "documents", "doc_id").join(table(spark, d, "labels", "doc_id"), "doc_id", "left_anti")


@query("join5_shared_keys", "SELECT doc_id FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE n_chars > 1000 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en')")
def join5(spark, d):
    docs = table(spark, d, "documents", "doc_id", "n_chars", "lang")
    arms = [table(spark, d, "labels", "doc_id"), docs.filter("n_chars > 1000").select("doc_id"), docs.filter("lang = 'en'").select("doc_id")]
    return shared_keys(arms, "doc_id")


def shared_keys(arms, key):
    """Keys that every arm has."""
    out = arms[0].select(key)
    for arm in arms[1:]:
        out = out.intersect(arm.select(key))
    return out


@query("join6_fallback", f"WITH {SCORED} SELECT a.doc_id, a.label, round(coalesce(b.p, a.p), 9) AS p FROM scored a LEFT JOIN scored b ON a.doc_id = b.doc_id AND a.label = b.label AND b.arm = 'b' AND b.n_chars > 1500 WHERE a.arm = 'a'")
def join6(spark, d):
    rows = scored(spark, d)
    table_ = rows.filter("arm = 'b' and n_chars > 1500").select("doc_id", "label", F.col("p").alias("better"))
    return rows.filter("arm = 'a'").join(table_, ["doc_id", "label"], "left").select("doc_id", "label", F.round(F.coalesce("better", "p"), 9).alias("p"))


@query("join7_group_or_own", "SELECT coalesce(n_name, 'nofp_' || s_suppkey) AS grp, count(*) AS n FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3 GROUP BY 1")
def join7(spark, d):
    nation = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").filter("n_regionkey < 3")
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.groupBy(F.coalesce("n_name", F.concat(F.lit("nofp_"), "s_suppkey")).alias("grp")).agg(F.count("*").alias("n"))


@query(
    "join8_same_text_other_labels",
    """WITH t AS (SELECT sha256(text) AS h, doc_id, quality, toxic FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS groups, sum(n)::BIGINT AS docs, count(*) FILTER (kinds > 1) AS contradicting FROM (SELECT h, count(*) AS n, count(DISTINCT quality * 2 + toxic) AS kinds FROM t GROUP BY h HAVING count(*) > 1)""",
)
def join8(spark, d):
    t = documents(spark, d).select("doc_id", F.sha2("text", 256).alias("h")).join(table(spark, d, "labels"), "doc_id")
    g = t.groupBy("h").agg(F.count("*").alias("n"), F.countDistinct("quality", "toxic").alias("kinds")).filter("n > 1")
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("docs"), F.count_if(F.col("kinds") > 1).alias("contradicting"))


@query("join9_duplicate_pairs", "WITH f AS (SELECT text, min(doc_id) AS dup_of FROM documents GROUP BY text) SELECT doc_id, dup_of FROM documents JOIN f USING (text) WHERE doc_id <> dup_of")
def join9(spark, d):
    docs = documents(spark, d).select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("dup_of"))
    return docs.join(first, "h").filter("doc_id <> dup_of").select("doc_id", "dup_of")


MAPS = "m1 AS (SELECT doc_id AS item, doc_id * 7 % 1000 AS study FROM documents), m2 AS (SELECT doc_id AS item, CASE WHEN doc_id % 10 = 0 THEN -1 ELSE doc_id * 7 % 1000 END AS study FROM documents WHERE doc_id % 13 <> 0)"


def maps(spark, d):
    docs = table(spark, d, "documents", "doc_id")
    study = F.col("doc_id") * 7 % 1000
    return docs.select(F.col("doc_id").alias("item"), study.alias("study")), docs.filter("doc_id % 13 <> 0").select(F.col("doc_id").alias("item"), F.when(F.col("doc_id") % 10 == 0, F.lit(-1).cast("long")).otherwise(study).alias("study"))


@query("join10_two_keys", f"WITH {MAPS} SELECT count(*) AS matched, (SELECT count(*) FROM m2) - count(*) AS dropped FROM m1 JOIN m2 USING (item, study)")
def join10(spark, d):
    a, b = maps(spark, d)
    j = b.join(a.withColumn("hit", F.lit(True)), ["item", "study"], "left")
    return j.agg(F.count("hit").alias("matched"), (F.count("*") - F.count("hit")).alias("dropped"))


@query("join11_rekey", f"WITH {MAPS} SELECT m2.item, m1.study FROM m2 LEFT JOIN m1 USING (item)")
def join11(spark, d):
    a, b = maps(spark, d)
    return b.select("item").join(a, "item", "left")


@query("join12_drift", f"WITH {MAPS} SELECT count(*) FILTER (m1.study = m2.study) AS shared, count(*) FILTER (m1.study <> m2.study) AS moved, count(*) FILTER (m2.item IS NULL) AS absent FROM m1 FULL JOIN m2 USING (item)")
def join12(spark, d):
    a, b = maps(spark, d)
    j = a.join(b.select("item", F.col("study").alias("other"), F.lit(1).alias("there")), "item", "full")
    return j.agg(F.count_if(F.col("study") == F.col("other")).alias("shared"), F.count_if(F.col("study") != F.col("other")).alias("moved"), F.count_if(F.col("there").isNull()).alias("absent"))


@query(
    "join13_declared_diff",
    """WITH a AS (SELECT n_nationkey AS field, n_regionkey AS v FROM nation), b AS (SELECT n_nationkey AS field, CASE WHEN n_nationkey % 4 = 0 THEN 9 ELSE n_regionkey END AS v FROM nation WHERE n_nationkey <> 7)
SELECT field, CASE WHEN a.v IS NOT DISTINCT FROM b.v THEN 'PASS' WHEN field % 8 = 0 THEN 'DECL' ELSE 'DIFF' END AS verdict FROM a FULL JOIN b USING (field)""",
)
def join13(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("field"), F.col("n_regionkey").alias("v"))
    b = a.filter("field <> 7").select("field", F.when(F.col("field") % 4 == 0, 9).otherwise(F.col("v")).alias("w"))
    declared = a.filter("field % 8 = 0").select("field", F.lit(True).alias("declared"))
    j = a.join(b, "field", "full").join(F.broadcast(declared), "field", "left")
    return j.select("field", F.when(F.col("v").eqNullSafe(F.col("w")), "PASS").when(F.col("declared"), "DECL").otherwise("DIFF").alias("verdict"))


@query("join14_manifest", "SELECT k, count(DISTINCT v) = 1 AS agree FROM (SELECT unnest(['lang', 'parity']) AS k, unnest([lang, CAST(doc_id % 2 AS VARCHAR)]) AS v FROM documents WHERE doc_id % 2 = 0) GROUP BY k")
def join14(spark, d):
    m = table(spark, d, "documents", "doc_id", "lang").filter("doc_id % 2 = 0")
    rows = m.select(F.explode(F.create_map(F.lit("lang"), "lang", F.lit("parity"), (F.col("doc_id") % 2).cast("string"))).alias("k", "v"))
    return rows.groupBy("k").agg((F.countDistinct("v") == 1).alias("agree"))


@query("agg1_label_coverage", f"WITH {GOLD} SELECT label, count(*) AS n, sum(y)::BIGINT AS n_pos, round(avg(y), 6) AS rate FROM gold GROUP BY label")
def agg1(spark, d):
    return gold(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"), r6(F.avg("y")).alias("rate"))


@query("agg2_coverage_by_language", "SELECT lang, count(*) AS n, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def agg2(spark, d):
    j = table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"))


@query("agg3_length_profile", "SELECT round(quantile_cont(length(text), 0.05), 4) AS p05, round(quantile_cont(length(text), 0.5), 4) AS p50, round(quantile_cont(length(text), 0.95), 4) AS p95, max(length(text))::BIGINT AS longest FROM documents")
def agg3(spark, d):
    q = F.percentile(F.length("text"), F.array(*[F.lit(x) for x in (0.05, 0.5, 0.95)]))
    return documents(spark, d).agg(*[F.round(q[i], 4).alias(n) for i, n in enumerate(("p05", "p50", "p95"))], F.max(F.length("text")).cast("long").alias("longest"))


@query("agg4_children", "SELECT median(n)::DOUBLE AS med, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def agg4(spark, d):
    c = table(spark, d, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return c.agg(F.median("n").alias("med"), r6(F.avg("n")).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("agg5_count_cube", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def agg5(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("agg6_crosstab", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS O, count(*) FILTER (l_linestatus = 'F') AS F FROM lineitem GROUP BY 1")
def agg6(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1))).na.fill(0)


@query("agg7_presence_pivot", "SELECT event_type, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS rate FROM (SELECT u.user_id, t.event_type, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type AND e.value > 60 GROUP BY ALL) GROUP BY 1")
def agg7(spark, d):
    e = table(spark, d, "events")
    present = e.filter("value > 60").groupBy("event_type").agg(F.countDistinct("user_id").alias("k"))
    kinds = e.select("event_type").distinct().join(present, "event_type", "left")
    total = F.broadcast(e.agg(F.countDistinct("user_id").alias("n")))
    return kinds.join(total).select("event_type", r6(F.coalesce("k", F.lit(0)) / F.col("n")).alias("rate"))


@query("agg8_redundancy", "SELECT count(*) FILTER ((l_returnflag = 'N') <> (l_linestatus = 'O')) = 0 AS redundant, count(*) FILTER ((l_returnflag = 'N') <> (l_linestatus = 'O')) AS off FROM lineitem")
def agg8(spark, d):
    off = F.count_if((F.col("l_returnflag") == "N") != (F.col("l_linestatus") == "O"))
    return table(spark, d, "lineitem").agg((off == 0).alias("redundant"), off.alias("off"))


@query("agg9_label_correlation", "SELECT round(corr(quality, toxic), 6) AS phi FROM labels")
def agg9(spark, d):
    return table(spark, d, "labels").agg(r6(corr("quality", "toxic")).alias("phi"))


@query("agg12_mode", "SELECT l_suppkey, l_returnflag AS top FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) = 1")
def agg12(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.mode("l_returnflag", True).alias("top"))


@query("agg13_group_median", "SELECT l_suppkey, round_even(median(l_tax), 3) AS med FROM lineitem GROUP BY 1")
def agg13(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.bround(F.median("l_tax"), 3).alias("med"))


@query("agg14_majority", f"SELECT source, vote FROM (SELECT source, {SPLIT} AS vote, count(*) AS n FROM documents WHERE {SPLIT} <> 'z' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, vote) = 1")
def agg14(spark, d):
    vote = F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, "y").otherwise("")
    return documents(spark, d).groupBy("source").agg(F.mode(F.nullif(vote, F.lit("")), True).alias("vote")).filter("vote is not null")


@query("agg15_key_audit", "SELECT count(*) AS parents, count(*) FILTER (n > 1) AS several, sum(n)::BIGINT - count(*) AS extra FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def agg15(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("parents"), F.count_if(F.col("n") > 1).alias("several"), (F.sum("n") - F.count("*")).alias("extra"))


@query("agg16_group_coverage", "WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT n FROM g ORDER BY n DESC LIMIT 20) SELECT (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM g WHERE n = 1) AS singletons, (SELECT median(n) FROM g)::DOUBLE AS med, (SELECT max(n) FROM g) AS largest, round((SELECT sum(n) FROM t) / (SELECT sum(n) FROM g)::DOUBLE, 6) AS top_share")
def agg16(spark, d):
    g = documents(spark, d).groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    top = F.broadcast(g.orderBy(F.desc("n")).limit(20).agg(F.sum("n").alias("top")))  # one row
    s = g.agg(F.count("*").alias("groups"), F.count_if(F.col("n") == 1).alias("singletons"), F.median("n").alias("med"), F.max("n").alias("largest"), F.sum("n").alias("total"))
    return s.join(top).select("groups", "singletons", "med", "largest", r6(F.col("top") / F.col("total")).alias("top_share"))


@query("agg17_confusion", f"WITH {SCORED}, e AS (SELECT arm, label, count(*) FILTER (p >= .5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= .5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p < .5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p < .5 AND y = 0)::DOUBLE AS tn FROM scored GROUP BY ALL) SELECT arm, label, round(tp / nullif(tp + fp, 0), 6) AS prec, round(tp / nullif(tp + fn, 0), 6) AS rec, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS acc FROM e")
def agg17(spark, d):
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    out = {"prec": F.try_divide(tp, tp + fp), "rec": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "acc": (tp + tn) / (tp + fp + fn + tn)}
    return errors(scored(spark, d)).select("arm", "label", *[r6(c).alias(n) for n, c in out.items()])


@query("agg18_error_direction", f"WITH {SCORED}, e AS (SELECT arm, label, count(*) FILTER (p >= .5 AND y = 0) AS fp, count(*) FILTER (p < .5 AND y = 1) AS fn FROM scored GROUP BY ALL) SELECT arm, label, fp, fn, round(abs(fp - fn) / nullif(fp + fn, 0)::DOUBLE, 6) AS skew, CASE WHEN fp + fn >= 3 AND fp >= 3 * fn THEN 'over' WHEN fp + fn >= 3 AND fn >= 3 * fp THEN 'under' ELSE 'mixed' END AS verdict FROM e")
def agg18(spark, d):
    fp, fn = F.col("fp"), F.col("fn")
    verdict = F.when((fp + fn >= 3) & (fp >= 3 * fn), "over").when((fp + fn >= 3) & (fn >= 3 * fp), "under").otherwise("mixed")
    return errors(scored(spark, d)).select("arm", "label", "fp", "fn", r6(F.try_divide(F.abs(fp - fn).cast("double"), (fp + fn).cast("double"))).alias("skew"), verdict.alias("verdict"))


@query("agg19_source_agreement", f"WITH {SCORED} SELECT x.arm AS arm_1, z.arm AS arm_2, round(avg(CASE WHEN (x.p >= .5) = (z.p >= .5) THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS agree FROM scored x JOIN scored z USING (doc_id, label) WHERE x.arm <> z.arm GROUP BY ALL")
def agg19(spark, d):
    rows = scored(spark, d).select("doc_id", "label", "arm", (F.col("p") >= 0.5).alias("hit"))
    a, b = (rows.select("doc_id", "label", F.col("arm").alias(f"arm_{i}"), F.col("hit").alias(f"hit_{i}")) for i in (1, 2))
    return a.join(b, ["doc_id", "label"]).filter("arm_1 <> arm_2").groupBy("arm_1", "arm_2").agg(r6(F.avg((F.col("hit_1") == F.col("hit_2")).cast("double"))).alias("agree"))


@query("agg20_duplicate_agreement", "WITH f AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text) SELECT count(*) AS pairs, count(*) FILTER (a.quality = b.quality) AS same_quality, count(*) FILTER (a.toxic = b.toxic) AS same_toxic FROM documents d JOIN f USING (text) JOIN labels a ON a.doc_id = d.doc_id JOIN labels b ON b.doc_id = f.first_id WHERE d.doc_id <> first_id")
def agg20(spark, d):
    labels = table(spark, d, "labels")
    pairs = join9(spark, d).join(labels, "doc_id").join(labels.select(F.col("doc_id").alias("dup_of"), F.col("quality").alias("q"), F.col("toxic").alias("t")), "dup_of")
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("quality") == F.col("q")).alias("same_quality"), F.count_if(F.col("toxic") == F.col("t")).alias("same_toxic"))


@query("agg21_grouping_sets", f"WITH {GOLD} SELECT lang, label, sum(y)::BIGINT AS k, count(*) AS n FROM gold GROUP BY GROUPING SETS ((lang), (label, lang))")
def agg21(spark, d):
    rows = gold(spark, d)
    return rows.groupingSets([[F.col("lang")], [F.col("label"), F.col("lang")]], "lang", "label").agg(F.sum("y").alias("k"), F.count("*").alias("n"))


@query("agg22_prevalence", f"WITH {GOLD}, b AS (SELECT lang FROM gold GROUP BY lang HAVING count(DISTINCT doc_id) >= 30) SELECT lang, round(avg(y) FILTER (label = 'quality'), 6) AS quality, round(avg(y) FILTER (label = 'toxic'), 6) AS toxic FROM gold WHERE lang IN (SELECT lang FROM b) GROUP BY lang")
def agg22(spark, d):
    p = gold(spark, d).groupBy("lang").pivot("label", ["quality", "toxic"]).agg(r6(F.avg("y")).alias("m"), F.count(F.lit(1)).alias("n"))
    return p.filter("quality_n >= 30").select("lang", F.col("quality_m").alias("quality"), F.col("toxic_m").alias("toxic"))


@query("agg23_volume", "SELECT lang, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / 3.6, 3) AS tokens, round(sum(length(text)) / 3.6 * 2.5 / 1e6, 6) AS cost FROM documents GROUP BY lang")
def agg23(spark, d):
    n = F.sum(F.length("text"))
    return documents(spark, d).groupBy("lang").agg(n.alias("chars"), F.round(n / 3.6, 3).alias("tokens"), r6(n / 3.6 * 2.5 / 1e6).alias("cost"))


@query("agg24_group_positives", "SELECT source, count(*) AS n, sum(quality)::BIGINT AS quality, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source")
def agg24(spark, d):
    j = table(spark, d, "documents", "doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))


@query("agg26_loss_references", f"WITH {SCORED}, r AS (SELECT label, avg(y) AS prior, avg(-(y * ln(least(1 - 1e-6, greatest(1e-6, p))) + (1 - y) * ln(1 - least(1 - 1e-6, greatest(1e-6, p))))) AS loss, avg(-(p2 * ln(p2) + (1 - p2) * ln(1 - p2))) AS floor FROM (SELECT *, least(1 - 1e-6, greatest(1e-6, p)) AS p2 FROM scored WHERE arm = 'c') GROUP BY label), q AS (SELECT *, -(prior * ln(prior) + (1 - prior) * ln(1 - prior)) AS constant FROM r) SELECT label, round(loss, 6) AS loss, round(constant, 6) AS constant, round((constant - loss) / (constant - floor), 6) AS position FROM q")
def agg26(spark, d):
    p, y = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("p"))), F.col("y")
    ent = lambda t, q: -(t * F.log(q) + (1 - t) * F.log(1 - q))
    r = scored(spark, d).filter("arm = 'c'").groupBy("label").agg(F.avg("y").alias("prior"), F.avg(ent(y, p)).alias("loss"), F.avg(ent(p, p)).alias("floor"))
    r = r.withColumn("constant", ent(F.col("prior"), F.col("prior")))
    return r.select("label", r6("loss").alias("loss"), r6("constant").alias("constant"), r6((F.col("constant") - F.col("loss")) / (F.col("constant") - F.col("floor"))).alias("position"))


@query("agg27_slot_histogram", "SELECT slots, count(*) AS users FROM (SELECT user_id, count(DISTINCT event_type) AS slots FROM events GROUP BY 1) GROUP BY 1")
def agg27(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("slots"))
    return s.groupBy("slots").agg(F.count("*").alias("users"))


@query("agg29_contract", "SELECT source, count(DISTINCT lang) = 1 AS single, count(DISTINCT lang) AS langs, round(avg(n_chars), 4) AS mean FROM documents GROUP BY source")
def agg29(spark, d):
    n = F.countDistinct("lang")
    return documents(spark, d).groupBy("source").agg((n == 1).alias("single"), n.alias("langs"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("agg31_ordered_children", "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds FROM events GROUP BY 1")
def agg31(spark, d):
    kids = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return table(spark, d, "events").groupBy("user_id").agg(kids.alias("k")).select("user_id", F.array_join(F.col("k.event_type"), ",").alias("kinds"))


@query("agg32_category_share", "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share, median(n_chars)::DOUBLE AS med FROM documents GROUP BY lang")
def agg32(spark, d):
    g = documents(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.median("n_chars").alias("med"))
    total = F.broadcast(g.agg(F.sum("n").alias("total")))
    return g.join(total).select("lang", "n", r6(F.col("n") / F.col("total")).alias("share"), "med")


@query("set1_union_first", "SELECT doc_id, min(src) AS src FROM (SELECT doc_id, 'gold' AS src FROM labels UNION ALL SELECT doc_id, 'rest' FROM documents WHERE doc_id % 4 = 0) GROUP BY doc_id")
def set1(spark, d):
    g = table(spark, d, "labels", "doc_id").withColumn("src", F.lit("gold"))
    rest = table(spark, d, "documents", "doc_id").filter("doc_id % 4 = 0").withColumn("src", F.lit("rest"))
    return g.unionByName(rest).groupBy("doc_id").agg(F.min("src").alias("src"))


@query("set2_key_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set2(spark, d):
    return table(spark, d, "customer", "c_custkey").exceptAll(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query("set4_intersect", "SELECT doc_id FROM documents WHERE n_chars > 500 INTERSECT SELECT doc_id FROM labels")
def set4(spark, d):
    return table(spark, d, "documents").filter("n_chars > 500").select("doc_id").intersect(table(spark, d, "labels", "doc_id"))


@query("set3_key_equality", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS extra")
def set3(spark, d):
    a, b = table(spark, d, "documents", "doc_id").withColumn("a", F.lit(1)), table(spark, d, "labels", "doc_id").withColumn("b", F.lit(1))
    return a.join(b, "doc_id", "full").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"))


def explode_labels(spark, d):
    return to_long(table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"])


@query("win3_keep_first", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def win3(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("o_custkey", "o_orderkey")
