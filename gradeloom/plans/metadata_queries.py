"""Metadata normalisation over lineitem, part and event tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.ranks import avg_rank, corr
from ..operators import metadata as m
from ..sources.publish import CheckFailed, publish, publish_default, read_current
from ..sources.tables import matrix_rows, read_written_csv, registry, require, shared_folder, table, to_wide, write_csv
from ..streaming.rebuild import current, rebuild_stream
from .base import GOLD, RANKED, SCORED, documents, gold, query, scored
from .metric_queries import r6

SERIES = """series AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'ax t1 se' WHEN 1 THEN 'sag t2 fs' WHEN 2 THEN 'cor pd fatsat' WHEN 3 THEN 't1 t2 mix' ELSE 'loc' END AS descr,
    CASE p_partkey % 5 WHEN 0 THEN 'GR' ELSE 'SE' END AS kind, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size * 40.0::DOUBLE END AS tr, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size * 2.0::DOUBLE END AS te,
    CASE p_partkey % 3 WHEN 0 THEN 'SAT_GEMS|FS' WHEN 1 THEN 'SAT_GEMS|PFP' ELSE 'fs |x' END AS opts, p_size FROM part)"""
WEIGHT = r"""CASE WHEN regexp_matches(descr, '\bt1') AND NOT regexp_matches(descr, '\bt2') AND NOT regexp_matches(descr, '\bpd') THEN 'T1' WHEN regexp_matches(descr, '\bt2') AND NOT regexp_matches(descr, '\bpd') THEN 'T2'
    WHEN regexp_matches(descr, '\bpd') THEN 'PD' WHEN kind = 'GR' THEN 'GRE' WHEN tr < 800 THEN 'T1' WHEN te > 60 THEN 'T2' WHEN tr >= 800 THEN 'PD' ELSE 'UNK' END"""
FAT = r"(regexp_matches(descr, '\b(fs|fatsat)\b') OR len(list_filter(string_split(upper(opts), '|'), lambda t: trim(t) = 'FS')) > 0)"
NOTED = f"{SERIES}, noted AS (SELECT p_partkey, p_size, {WEIGHT} AS weight, {FAT} AS fat FROM series)"


def noted(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda n, *vs: F.element_at(F.array(*map(F.lit, vs)), (k % n + 1).cast("int"))
    descr = pick(7, "ax t1 se", "sag t2 fs", "cor pd fatsat", "t1 t2 mix", "loc", "loc", "loc")
    kind, opts = F.when(k % 5 == 0, "GR").otherwise("SE"), pick(3, "SAT_GEMS|FS", "SAT_GEMS|PFP", "fs |x")
    tr, te = F.when(size % 4 != 0, size * 40.0), F.when(size % 6 != 0, size * 2.0)
    fat = descr.rlike(r"\b(fs|fatsat)\b") | m.token_in(opts, "FS")
    return table(spark, d, "part").select("p_partkey", "p_size", m.weighting(descr, kind, tr, te).alias("weight"), fat.alias("fat"))


@query("meta1_protocol", f"WITH {NOTED} SELECT p_partkey, weight, fat FROM noted")
def meta1(spark, d):
    return noted(spark, d).select("p_partkey", "weight", "fat")


SLOTS = [("t1", "T1", None), ("fluid_fs", "PD", True), ("fluid", "PD", False), ("t2", "T2", None)]


@query(
    "meta2_slots",
    f"""WITH {NOTED}, slots AS (SELECT * FROM (VALUES ('t1', 'T1', NULL::BOOLEAN), ('fluid_fs', 'PD', true), ('fluid', 'PD', false), ('t2', 'T2', NULL)) s(slot, w, f)),
c AS (SELECT p_partkey % 50 AS study, slot, p_partkey, p_size FROM noted JOIN slots ON weight = w AND (f IS NULL OR f = fat))
SELECT study, slot, p_partkey FROM c QUALIFY row_number() OVER (PARTITION BY study, slot ORDER BY p_size DESC, p_partkey) = 1""",
)
def meta2(spark, d):
    slots = spark.createDataFrame(SLOTS, "slot string, weight string, f boolean")
    c = noted(spark, d).join(F.broadcast(slots), "weight").filter("f is null or f = fat")
    return c.groupBy((F.col("p_partkey") % 50).alias("study"), "slot").agg(F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("p_partkey"))


@query(
    "meta3_fingerprint",
    """WITH a AS (SELECT l_suppkey, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) = 1),
b AS (SELECT l_suppkey, l_linestatus AS v, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY l_suppkey, l_linestatus QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linestatus) = 1),
c AS (SELECT l_suppkey, round_even(median(l_tax), 3) AS t FROM lineitem GROUP BY 1)
SELECT l_suppkey, a.v || '|' || coalesce(b.v, 'NA') || '|' || format('{:.3f}', t) AS fingerprint FROM a LEFT JOIN b USING (l_suppkey) JOIN c USING (l_suppkey)""",
)
def meta3(spark, d):
    l = table(spark, d, "lineitem").withColumn("late", F.when(F.col("l_linenumber") > 2, F.col("l_linestatus")))  # noqa: E741
    return m.fingerprint(l, "l_suppkey", ["l_returnflag", "late"], "l_tax")


EVX = "ex AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN 'R' WHEN event_id % 4 = 1 THEN ' ' ELSE NULL END AS tag, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id * 37 % 301 - 150)::DOUBLE END AS x FROM events)"


def event_sides(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    tag = F.when(i % 4 == 0, "R").when(i % 4 == 1, " ")
    x = F.when(i % 5 == 0, F.when(i % 2 == 0, float("nan"))).otherwise((i * 37 % 301 - 150).cast("double"))
    return e.select("event_id", "user_id", tag.alias("tag"), x.alias("x"))


@query("meta4_side", f"WITH {EVX} SELECT event_id, coalesce(nullif(trim(tag), ''), CASE WHEN x < -62 THEN 'R' WHEN x >= -62 THEN 'L' END) AS side, CASE WHEN nullif(trim(tag), '') IS NOT NULL THEN 'tag' WHEN x IS NOT NULL THEN 'geometry' ELSE 'none' END AS origin FROM ex")
def meta4(spark, d):
    s, origin = m.side(F.col("tag"), F.col("x"))
    return event_sides(spark, d).select("event_id", s.alias("side"), origin.alias("origin"))


@query("agg28_side_counters", f"WITH {EVX}, s AS (SELECT CASE WHEN nullif(trim(tag), '') IS NOT NULL THEN 'tag' WHEN x IS NOT NULL THEN 'geometry' ELSE 'none' END AS origin FROM ex) SELECT origin, count(*) AS n FROM s GROUP BY origin")
def agg28(spark, d):
    return meta4(spark, d).groupBy("origin").agg(F.count("*").alias("n"))


@query("meta5_centre_side", f"WITH {EVX}, c AS (SELECT user_id, median(x) AS c FROM ex GROUP BY 1) SELECT user_id, CASE WHEN abs(c) >= 20 THEN CASE WHEN c < 0 THEN 'R' ELSE 'L' END END AS side FROM c")
def meta5(spark, d):
    x = F.when(~F.isnan("x"), F.col("x"))
    return event_sides(spark, d).groupBy("user_id").agg(F.median(x).alias("c")).select("user_id", m.centre_side(F.col("c")).alias("side"))


@query("meta6_corner_side", f"WITH {EVX}, c AS (SELECT user_id, avg(x) AS c, count(DISTINCT nullif(trim(tag), '')) AS tags, max(nullif(trim(tag), '')) AS tag FROM ex GROUP BY 1) SELECT user_id, CASE WHEN tags = 1 THEN tag WHEN abs(c) >= 25 THEN CASE WHEN c < 0 THEN 'R' ELSE 'L' END END AS side FROM c")
def meta6(spark, d):
    tag, x = F.nullif(F.trim("tag"), F.lit("")), F.when(~F.isnan("x"), F.col("x"))
    c = event_sides(spark, d).groupBy("user_id").agg(F.avg(x).alias("c"), F.countDistinct(tag).alias("tags"), F.max(tag).alias("tag"))
    return c.select("user_id", F.when(F.col("tags") == 1, F.col("tag")).otherwise(m.centre_side(F.col("c"), 25.0)).alias("side"))


TRUTH = f"{EVX}, tr AS (SELECT *, CASE WHEN event_id * 37 % 301 < 100 THEN 'R' ELSE 'L' END AS truth FROM ex WHERE x IS NOT NULL)"


def truth(spark, d):
    t = F.when(F.col("event_id") * 37 % 301 < 100, "R").otherwise("L")
    return event_sides(spark, d).filter("x is not null and not isnan(x)").withColumn("truth", t)


@query("meta7_rule_agreement", f"WITH {TRUTH} SELECT truth, count(*) FILTER (x < 0) AS r, count(*) FILTER (x >= 0) AS l, round(avg(CASE WHEN (x < 0) = (truth = 'R') THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS agree FROM tr GROUP BY truth")
def meta7(spark, d):
    right = F.col("x") < 0
    return truth(spark, d).groupBy("truth").agg(F.count_if(right).alias("r"), F.count_if(~right).alias("l"), r6(F.avg((right == (F.col("truth") == "R")).cast("double"))).alias("agree"))


@query("meta8_threshold_sweep", f"WITH {TRUTH} SELECT cut, round(avg(CASE WHEN (x < cut) = (truth = 'R') THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS agree FROM tr, (SELECT unnest(range(-100, 101, 20)) AS cut) GROUP BY cut")
def meta8(spark, d):
    cuts = F.explode(F.sequence(F.lit(-100).cast("long"), F.lit(100).cast("long"), F.lit(20).cast("long")))
    return truth(spark, d).withColumn("cut", cuts).groupBy("cut").agg(r6(F.avg(((F.col("x") < F.col("cut")) == (F.col("truth") == "R")).cast("double"))).alias("agree"))


@query("meta9_geometry_verdict", f"WITH {EVX} SELECT count(*) FILTER (x < -20) AS neg, count(*) FILTER (x > 20) AS pos, count(*) FILTER (abs(x) <= 20) AS near, CASE WHEN count(*) FILTER (x < -20) > 0 AND count(*) FILTER (x > 20) > 0 THEN 'usable' ELSE 'one-sided' END AS verdict FROM ex")
def meta9(spark, d):
    x = F.when(~F.isnan("x"), F.col("x"))
    neg, pos = F.count_if(x < -20), F.count_if(x > 20)
    return event_sides(spark, d).agg(neg.alias("neg"), pos.alias("pos"), F.count_if(F.abs(x) <= 20).alias("near"), F.when((neg > 0) & (pos > 0), "usable").otherwise("one-sided").alias("verdict"))


@query("meta10_plane", "WITH v AS (SELECT vec_id, abs(embedding[2] * embedding[6]::DOUBLE - embedding[3] * embedding[5]::DOUBLE) AS x, abs(embedding[3] * embedding[4]::DOUBLE - embedding[1] * embedding[6]::DOUBLE) AS y, abs(embedding[1] * embedding[5]::DOUBLE - embedding[2] * embedding[4]::DOUBLE) AS z FROM embeddings) SELECT vec_id, CASE WHEN x = greatest(x, y, z) THEN 'sag' WHEN y = greatest(x, y, z) THEN 'cor' ELSE 'ax' END AS plane FROM v")
def meta10(spark, d):
    from .array_queries import cross, halves

    size = F.transform(cross(*halves()), lambda v: F.abs(v))
    plane = F.element_at(F.array(F.lit("sag"), F.lit("cor"), F.lit("ax")), F.array_position(size, F.array_max(size)).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", plane.alias("plane"))


@query("meta11_structure_compare", "WITH a AS (SELECT o_orderkey AS k, count(*) AS n, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), b AS (SELECT o_orderkey AS k, count(*) AS n, sum(l_quantity + l_linenumber % 2) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber < 6 GROUP BY 1) SELECT round(avg(CASE WHEN a.n = b.n THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS same_n, round(median(abs(a.q - b.q)), 4) AS med, round(quantile_cont(abs(a.q - b.q), 0.95), 4) AS p95 FROM a JOIN b USING (k)")
def meta11(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "orders", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")  # noqa: E741
    few = F.col("l_linenumber") < 6
    g = l.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.count_if(few).alias("n2"), F.sum(F.when(few, F.col("l_quantity") + F.col("l_linenumber") % 2)).alias("q2")).filter("n2 > 0")
    gap = F.abs(F.col("q") - F.col("q2"))
    return g.agg(r6(F.avg((F.col("n") == F.col("n2")).cast("double"))).alias("same_n"), F.round(F.median(gap), 4).alias("med"), F.round(F.percentile(gap, F.lit(0.95)), 4).alias("p95"))


@query("meta12_child_counts", "SELECT o_custkey, n, want FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN (SELECT c_custkey, 5 + c_custkey % 11 AS want FROM customer) ON o_custkey = c_custkey WHERE n <> want ORDER BY o_custkey LIMIT 20")
def meta12(spark, d):
    n = table(spark, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))
    want = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 11 + 5).alias("want"))
    return n.join(want, "o_custkey").filter("n <> want").select("o_custkey", "n", "want").orderBy("o_custkey").limit(20)


@query("meta13_completeness", "WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), t AS (SELECT user_id, count(*) AS n FROM events WHERE user_id % 5 <> 0 AND (user_id % 3 <> 0 OR value > 30) GROUP BY 1) SELECT user_id, CASE WHEN t.n IS NULL THEN 'new' WHEN s.n > t.n THEN 'rebuild' ELSE 'skip' END AS action FROM s LEFT JOIN t USING (user_id)")
def meta13(spark, d):
    e = table(spark, d, "events", "user_id", "value")
    return m.completeness(e, e.filter("user_id % 5 <> 0 and (user_id % 3 <> 0 or value > 30)"), "user_id")


@query("meta13_rebuild_stream", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS n_click, min(value) AS least, max(value) AS most FROM events GROUP BY user_id")
def meta13_stream(spark, d):
    """The events' files as a stream: users whose events grew are built anew, batch by batch; what the last batch left is the result."""
    events = table(spark, d, "events")
    schema = ", ".join(f"`{n}` {k}" for n, k in events.dtypes)
    root = f"{shared_folder(spark)}/rebuild-{uuid.uuid4().hex}"
    build = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("n_click"), F.min("value").alias("least"), F.max("value").alias("most"))
    rebuild_stream(spark, f"{d}/events.parquet", schema, f"{root}/built", "user_id", build, f"{root}/state").awaitTermination()
    return current(spark.read.parquet(f"{root}/built"), "user_id").select("user_id", "n", "n_click", "least", "most")


@query("meta16_features", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'purchase') > 0 AS has_purchase FROM events GROUP BY 1")
def meta16(spark, d):
    n = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), n("click").alias("n_click"), n("view").alias("n_view"), (n("purchase") > 0).alias("has_purchase"))


@query("agg30_presence", "SELECT user_id, bool_or(event_type = 'click') AS has_click, bool_or(event_type = 'view') AS has_view, round(count(DISTINCT event_type) / 4.0, 6)::DOUBLE AS fill FROM events GROUP BY 1")
def agg30(spark, d):
    has = lambda k: F.bool_or(F.col("event_type") == k)
    return table(spark, d, "events").groupBy("user_id").agg(has("click").alias("has_click"), has("view").alias("has_view"), r6(F.countDistinct("event_type") / 4.0).alias("fill"))


@query("win9_physical_order", "WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 AND l_linenumber = 2 THEN NULL ELSE l_quantity * 0.6 - l_discount * 80 END AS pos FROM lineitem), k AS (SELECT *, count(*) FILTER (pos IS NULL) OVER (PARTITION BY l_orderkey) = 0 AS ok FROM p) SELECT l_orderkey, l_linenumber, ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN ok THEN pos ELSE l_linenumber::DOUBLE END, l_linenumber)::INTEGER AS place FROM k")
def win9(spark, d):
    l = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")  # noqa: E741
    pos = F.when(~((F.col("l_orderkey") % 4 == 0) & (F.col("l_linenumber") == 2)), F.col("l_quantity") * 0.6 - F.col("l_discount") * 80)
    return m.physical_order(l, "l_orderkey", pos, "l_linenumber").select("l_orderkey", "l_linenumber", "ok", "place")


@query("win10_spread_axis", "WITH s AS (SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS a, (max(l_discount) - min(l_discount)) * 400 AS b, (max(l_tax) - min(l_tax)) * 500 AS c FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN a = greatest(a, b, c) THEN 0 WHEN b = greatest(a, b, c) THEN 1 ELSE 2 END AS axis FROM s")
def win10(spark, d):
    spread = lambda c, k=1: (F.max(c) - F.min(c)) * k
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array(spread("l_quantity"), spread("l_discount", 400), spread("l_tax", 500)).alias("s"))
    return s.select("l_orderkey", (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("axis"))


ORDERS = "r AS (SELECT l_orderkey, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + (count(*) OVER (PARTITION BY l_orderkey, l_linenumber) - 1) / 2.0::DOUBLE AS b FROM lineitem), c AS (SELECT l_orderkey, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1)"


#: Lines of a task: windows sort all rows of a task in memory, once for each order.
LINES_A_TASK = 500_000


def order_signs(spark, d):
    l = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_linenumber")  # noqa: E741
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + l.count() // LINES_A_TASK)
    l = l.repartition(tasks, "l_orderkey")  # noqa: E741
    r = l.select("l_orderkey", avg_rank("l_quantity", "l_orderkey").alias("a"), avg_rank("l_linenumber", "l_orderkey").alias("b"))
    c = r.groupBy("l_orderkey").agg(F.count("*").alias("n"), corr("a", "b").alias("rho"))
    return c.withColumn("sign", F.when(F.col("rho").isNull() | F.isnan("rho") | (F.abs("rho") < 1e-9), 0).otherwise(F.signum("rho").cast("int")))


@query("win11_order_agreement", f"WITH {ORDERS} SELECT l_orderkey, CASE WHEN rho IS NULL OR isnan(rho) OR abs(rho) < 1e-9 THEN 0 WHEN rho > 0 THEN 1 ELSE -1 END AS sign FROM c")
def win11(spark, d):
    return order_signs(spark, d).select("l_orderkey", "sign")


@query("win12_rule_adoption", f"WITH {ORDERS}, s AS (SELECT n, CASE WHEN rho IS NULL OR isnan(rho) OR abs(rho) < 1e-9 THEN 0 WHEN rho > 0 THEN 1 ELSE -1 END AS sign FROM c) SELECT n, count(*) AS orders, round(avg(CASE WHEN sign = 1 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS accuracy, CASE WHEN count(*) = count(*) FILTER (sign = 1) THEN 'adopt' ELSE 'reject' END AS verdict FROM s GROUP BY n")
def win12(spark, d):
    hit = F.avg((F.col("sign") == 1).cast("double"))
    return order_signs(spark, d).groupBy("n").agg(F.count("*").alias("orders"), r6(hit).alias("accuracy"), F.when(hit == 1, "adopt").otherwise("reject").alias("verdict"))


@query("win15_jittered_sample", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT DISTINCT user_id, event_id FROM e, range(4) t(j) WHERE i = least(n - 1, j * n // 4 + (user_id * 31 + j * 17) % greatest(1, n // 4))")
def win15(spark, d):
    from .window_queries import ordered_events

    spot = lambda j: F.least(F.col("n") - 1, F.floor(j * F.col("n") / 4) + F.pmod(F.col("user_id") * 31 + j * 17, F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / 4))))
    return ordered_events(spark, d).filter(F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(3)), spot), F.col("i"))).select("user_id", "event_id")


@query("src1_csv_round_trip", "SELECT doc_id, sha256(text) AS digest, lang, n_chars FROM documents")
def src1(spark, d):
    """Documents written as CSV, with line breaks and quotes in texts, and read back by a given schema; nulls and empty texts stay apart."""
    docs = documents(spark, d).select("doc_id", "text", "lang", "n_chars")
    back = read_written_csv(spark, write_csv(docs), docs.schema)
    return back.select("doc_id", F.sha2("text", 256).alias("digest"), "lang", "n_chars")


@query("src2_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'")
def src2(spark, d):
    return table(spark, d, "lineitem").filter(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_quantity")


@query("src6_registry", f"WITH {SCORED} SELECT arm AS source, count(*) AS n, round(avg(p), 6) AS mean FROM scored WHERE arm <> 'b' GROUP BY arm")
def src6(spark, d):
    rows = scored(spark, d)
    sources = {"a": rows.filter("arm = 'a'"), "b": rows.filter("arm = 'b'").drop("p"), "c": rows.filter("arm = 'c'")}
    return registry(sources, ["doc_id", "label", "p"]).groupBy("source").agg(F.count("*").alias("n"), r6(F.avg("p")).alias("mean"))


@query("src7_schema_gate", "SELECT doc_id, quality, toxic FROM labels")
def src7(spark, d):
    """The first table that has the key and all targets; an error if none has."""
    for name in ("documents", "labels", "events"):
        t = table(spark, d, name)
        if {"doc_id", "quality", "toxic"} <= set(t.columns):
            return t.select("doc_id", "quality", "toxic")
    return require(table(spark, d, "labels"), "doc_id", "quality", "toxic")


@query("src8_matrix_import", "SELECT vec_id, list_extract(['x', 'y', 'z'], i)::VARCHAR AS label, embedding[i]::DOUBLE AS p FROM embeddings, (SELECT unnest([1, 2, 3]) AS i)")
def src8(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.array(*map(F.lit, "xyz")).alias("names"), F.slice("embedding", 1, 3).alias("v"))
    return matrix_rows(rows, ["vec_id"], F.col("names"), F.col("v"), list("xyz")).select("vec_id", "label", F.col("p").cast("double").alias("p"))


@query("src9_wide_output", f"WITH {RANKED}, w AS (SELECT doc_id, max(avg_rank / n) FILTER (label = 'quality') AS quality, max(avg_rank / n) FILTER (label = 'toxic') AS toxic FROM ranked WHERE arm = 'c' GROUP BY doc_id) SELECT doc_id, round(coalesce(quality, 0.5), 8) AS quality, round(coalesce(toxic, 0.5), 8) AS toxic FROM documents LEFT JOIN w USING (doc_id)")
def src9(spark, d):
    """A default for every document is published first; the ranks replace it once they are complete and have passed the checks."""
    from ..functions.ranks import ranked

    ids, root = documents(spark, d).select("doc_id"), f"{shared_folder(spark)}/output-{uuid.uuid4().hex}"
    publish_default(ids, root, "doc_id", ["quality", "toxic"])
    wide = to_wide(ranked(scored(spark, d).filter("arm = 'c'"), ["label"], "p"), ["doc_id"], ["quality", "toxic"], value="pct_rank")
    out = ids.join(wide, "doc_id", "left").select("doc_id", *[F.round(F.coalesce(c, F.lit(0.5)), 8).alias(c) for c in ("quality", "toxic")])
    publish(out, root, ids, "doc_id", ["quality", "toxic"])
    return read_current(spark, root)


@query("src10_default_output", "SELECT doc_id, 0.5::DOUBLE AS quality, 0.5::DOUBLE AS toxic FROM documents")
def src10(spark, d):
    """A replacement that lacks documents and holds nulls is staged and refused: the default that was written first is what readers find."""
    ids, root = documents(spark, d).select("doc_id"), f"{shared_folder(spark)}/output-{uuid.uuid4().hex}"
    publish_default(ids, root, "doc_id", ["quality", "toxic"])
    labels = table(spark, d, "labels").select("doc_id", F.nullif(F.col("quality").cast("double"), F.lit(0.0)).alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    try:
        publish(labels, root, ids, "doc_id", ["quality", "toxic"])
    except CheckFailed:
        return read_current(spark, root)
    raise AssertionError("an incomplete replacement was published")


@query("src12_item_map", "SELECT doc_id AS item_id, sha256(text) AS study FROM documents")
def src12(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("study"))


@query("src3_glossary_rows", f"WITH {GOLD} SELECT label AS key, lang, count(*) AS n FROM gold GROUP BY ALL")
def src3(spark, d):
    """A nested map key -> language -> entries, read back from JSON and exploded to rows."""
    nested = gold(spark, d).groupBy("label", "lang").agg(F.count("*").alias("n"))
    nested = nested.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m")).select(F.to_json(F.create_map("label", "m")).alias("j"))
    rows = nested.select(F.explode(F.from_json("j", "map<string, map<string, bigint>>")).alias("key", "m"))
    return rows.select("key", F.explode("m").alias("lang", "n"))

