"""Vectors, geometry, hashes and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import numbered
from ..sources.tables import table
from .base import documents, query
from .metric_queries import r6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; 0 where one is constant."""
    n, total = F.size(a), lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    sa, sb = total(a), total(b)
    spread = F.sqrt((n * dot(a, a) - sa * sa) * (n * dot(b, b) - sb * sb))
    return F.when(spread > 1e-12, (n * dot(a, b) - sa * sb) / spread).otherwise(0.0)


def class_means(spark, d) -> DataFrame:
    """label and mean vector of each class of embeddings, summed element by element."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


MEANS = """m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL),
means AS (SELECT label, list(x ORDER BY i) AS mean FROM m GROUP BY label), vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"""


@query("arr1_best_candidate", f"WITH {MEANS}, c AS (SELECT vec_id, means.label AS cand, (SELECT corr(a, b) FROM (SELECT unnest(v) AS a, unnest(mean) AS b)) AS r FROM vec, means), t AS (SELECT vec_id, cand, r, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, cand) AS k FROM c) SELECT vec_id, max(cand) FILTER (k = 1) AS best, round(max(r) FILTER (k = 1) - max(r) FILTER (k = 2), 6) AS margin FROM t GROUP BY vec_id")
def arr1(spark, d):
    """The class whose mean correlates best with each vector, and the margin to the second."""
    cands = F.broadcast(class_means(spark, d).agg(F.collect_list(F.struct("label", "mean")).alias("cands")))  # one row: a class is a few numbers
    rs = F.sort_array(F.transform("cands", lambda c: F.struct((-pearson(F.col("embedding"), c["mean"])).alias("r"), c["label"].alias("label"))))
    t = table(spark, d, "embeddings").join(cands).select("vec_id", rs.alias("t"))
    return t.select("vec_id", F.col("t")[0]["label"].alias("best"), r6(F.col("t")[1]["r"] - F.col("t")[0]["r"]).alias("margin"))


@query("arr2_leave_one_out_distance", f"WITH {MEANS}, s AS (SELECT i, sum(x) AS s, count(*) AS k FROM m GROUP BY i), dist AS (SELECT label, sqrt(sum(power(m.x - (s.s - m.x) / (k - 1), 2))) AS dist FROM m JOIN s USING (i) GROUP BY label) SELECT label, round(dist, 6) AS dist, dist = (SELECT max(dist) FROM dist) AS odd FROM dist")
def arr2(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    s = m.groupBy("i").agg(F.sum("x").alias("s"), F.count("*").alias("k"))
    dist = m.join(F.broadcast(s), "i").groupBy("label").agg(F.sqrt(F.sum(F.pow(F.col("x") - (F.col("s") - F.col("x")) / (F.col("k") - 1), F.lit(2)))).alias("dist"))
    top = F.broadcast(dist.agg(F.max("dist").alias("top")))
    return dist.join(top).select("label", r6("dist").alias("dist"), (F.col("dist") == F.col("top")).alias("odd"))


@query("arr3_nearest_by_error", f"WITH {MEANS}, c AS (SELECT vec_id, means.label AS cand, list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - mean[i]))) / len(v) AS mae FROM vec, means), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY mae, cand) AS k FROM c) SELECT vec_id, max(cand) FILTER (k = 1) AS best, round(max(mae) FILTER (k = 1), 6) AS err, round(max(mae) FILTER (k = 2) - max(mae) FILTER (k = 1), 6) AS gap FROM t GROUP BY vec_id")
def arr3(spark, d):
    cands = F.broadcast(class_means(spark, d).agg(F.collect_list(F.struct("label", "mean")).alias("cands")))
    mae = lambda m: F.aggregate(F.zip_with("embedding", m, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x) / F.size("embedding")
    t = table(spark, d, "embeddings").join(cands).select("vec_id", F.sort_array(F.transform("cands", lambda c: F.struct(mae(c["mean"]).alias("e"), c["label"].alias("label")))).alias("t"))
    return t.select("vec_id", F.col("t")[0]["label"].alias("best"), r6(F.col("t")[0]["e"]).alias("err"), r6(F.col("t")[1]["e"] - F.col("t")[0]["e"]).alias("gap"))


@query("arr4_class_cosines", f"WITH {MEANS} SELECT a.label AS label_1, b.label AS label_2, round(list_cosine_similarity(a.mean, b.mean), 6) AS cosine FROM means a JOIN means b ON a.label < b.label")
def arr4(spark, d):
    m = class_means(spark, d)
    a, b = (m.select(F.col("label").alias(f"label_{i}"), (F.col("mean")).alias(f"m{i}")) for i in (1, 2))
    x, y = F.col("m1"), F.col("m2")
    return a.join(F.broadcast(b), F.col("label_1") < F.col("label_2")).select("label_1", "label_2", r6(dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))).alias("cosine"))


@query("arr5_robust_rescale", "WITH q AS (SELECT event_type, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM events GROUP BY 1) SELECT event_id, round((least(hi, greatest(lo, value)) - lo) / (hi - lo), 6) AS x FROM events JOIN q USING (event_type)")
def arr5(spark, d):
    return rescaled(spark, d).select("event_id", r6("x").alias("x"))


def rescaled(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    q = e.groupBy("event_type").agg(F.percentile("value", F.lit(0.005)).alias("lo"), F.percentile("value", F.lit(0.995)).alias("hi"))
    return e.join(F.broadcast(q), "event_type").withColumn("x", (F.least("hi", F.greatest("lo", "value")) - F.col("lo")) / (F.col("hi") - F.col("lo")))


@query("arr6_quantise", "SELECT event_id, round_even((event_id % 1001) / 1000.0::DOUBLE * 255, 0)::SMALLINT::INTEGER AS q FROM events")
def arr6(spark, d):
    return table(spark, d, "events").select("event_id", F.bround(F.col("event_id") % 1001 / 1000.0 * 255).cast("smallint").cast("int").alias("q"))


@query("geo1_cross_dot", "WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS a1, embedding[2]::DOUBLE AS a2, embedding[3]::DOUBLE AS a3, embedding[4]::DOUBLE AS b1, embedding[5]::DOUBLE AS b2, embedding[6]::DOUBLE AS b3 FROM embeddings) SELECT vec_id, round(a2 * b3 - a3 * b2, 6) AS x, round(a3 * b1 - a1 * b3, 6) AS y, round(a1 * b2 - a2 * b1, 6) AS z, round(a1 * b1 + a2 * b2 + a3 * b3, 6) AS dot FROM v")
def geo1(spark, d):
    a, b = halves()
    c = cross(a, b)
    return table(spark, d, "embeddings").select("vec_id", *[r6(c[i]).alias(n) for i, n in enumerate("xyz")], r6(dot(a, b)).alias("dot"))


def halves() -> tuple[Column, Column]:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return F.slice(v, 1, 3), F.slice(v, 4, 3)


@query("geo2_consistent_orientation", "WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first_v FROM embeddings GROUP BY label) SELECT label, count(*) AS n, count(*) FILTER (abs(embedding[1] - first_v[1]) <= 0.1 AND abs(embedding[2] - first_v[2]) <= 0.1 AND abs(embedding[3] - first_v[3]) <= 0.1) AS close FROM embeddings JOIN f USING (label) GROUP BY label")
def geo2(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first_v"))
    near = F.forall(F.zip_with(F.slice("embedding", 1, 3), F.slice("first_v", 1, 3), lambda x, y: F.abs(x - y) <= F.lit(0.1).cast("float")), lambda x: x)
    return e.join(F.broadcast(first), "label").groupBy("label").agg(F.count("*").alias("n"), F.count_if(near).alias("close"))


@query("geo3_axis_and_obliquity", "WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), n AS (SELECT *, sqrt(a * a + b * b + c * c) AS len, greatest(abs(a), abs(b), abs(c)) AS m FROM v) SELECT vec_id, CASE WHEN abs(a) = m THEN 'x' WHEN abs(b) = m THEN 'y' ELSE 'z' END AS axis, round(degrees(acos(least(1.0, m / len))), 4) AS oblique FROM n")
def geo3(spark, d):
    a, _ = halves()
    size = F.transform(a, lambda x: F.abs(x))
    top = F.array_max(size)
    axis = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array_position(size, top).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", axis.alias("axis"), F.round(F.degrees(F.acos(F.least(F.lit(1.0), top / F.sqrt(dot(a, a))))), 4).alias("oblique"))


@query("json1_schema_parse", "SELECT event_type, count(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS parsed, sum(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER))::BIGINT AS total FROM events GROUP BY 1")
def json1(spark, d):
    k = F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("parsed"), F.sum(k).alias("total"))


@query("src4_request_lines", "SELECT format('r{:05d}', row_number() OVER (ORDER BY doc_id) - 1) AS id, doc_id, length(text) AS size FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def src4(spark, d):
    """Numbers go to ids alone, within ranges of them; texts are joined afterwards."""
    ids = table(spark, d, "documents", "doc_id").join(table(spark, d, "labels", "doc_id"), "doc_id", "left_semi")
    lo, hi = table(spark, d, "documents", "doc_id").agg(F.min("doc_id"), F.max("doc_id")).first()
    ids = numbered(ids, F.col("doc_id"), [], lo or 0, hi or 0)
    lines = documents(spark, d).join(ids, "doc_id").select(F.format_string("r%05d", "_n").alias("id"), F.to_json(F.struct("doc_id", "text")).alias("line"))
    body = F.from_json("line", "doc_id long, text string")
    return lines.select("id", body["doc_id"].alias("doc_id"), F.length(body["text"]).cast("long").alias("size"))


RESPONSE = """CASE WHEN event_id % 17 = 0 THEN 'errored' WHEN event_id % 13 = 0 THEN 'refusal' WHEN event_id % 11 = 0 THEN 'no_text' WHEN event_id % 7 = 0 THEN 'unparseable' ELSE 'ok' END"""


@query("src5_collect_responses", f"SELECT {RESPONSE} AS outcome, count(*) AS n, count(*) FILTER ({RESPONSE} = 'ok' AND user_id % 3 = 0) AS absent FROM events GROUP BY 1")
def src5(spark, d):
    e = table(spark, d, "events")
    ok = F.when(F.col("user_id") % 3 == 0, F.to_json(F.struct(F.lit("pos").alias("other")))).otherwise(F.to_json(F.struct(F.struct(F.lit("pos").alias("state")).alias("finding"))))
    text = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.lit("{oops")).otherwise(ok)
    status = F.when(F.col("event_id") % 17 == 0, "errored").when(F.col("event_id") % 13 == 0, "refusal").otherwise("succeeded")
    return collected(e.select(status.alias("status"), text.alias("text"))).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if((F.col("outcome") == "ok") & (F.col("state") == "absent")).alias("absent"))


def collected(responses: DataFrame) -> DataFrame:
    """(status, text) with the outcome and the finding's state, ``absent`` where a parsed response does not name it."""
    parsed = F.from_json("text", "finding struct<state: string, evidence: string>, _corrupt_record string", {"mode": "PERMISSIVE"})
    outcome = F.when(F.col("status") != "succeeded", F.col("status")).when(F.col("text").isNull(), "no_text").when(F.col("p._corrupt_record").isNotNull(), "unparseable").otherwise("ok")
    return responses.withColumn("p", parsed).select("status", outcome.alias("outcome"), F.coalesce("p.finding.state", F.lit("absent")).alias("state"))


@query("src11_tag_profile", "SELECT tag, count(v) AS present, count(DISTINCT v) AS kinds FROM (SELECT unnest(['lang', 'source', 'big']) AS tag, unnest([lang, source, CASE WHEN n_chars > 2000 THEN 'y' END]) AS v FROM documents) GROUP BY tag")
def src11(spark, d):
    big = F.when(F.col("n_chars") > 2000, "y")
    rows = documents(spark, d).select(F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("big"), big)).alias("tag", "v"))
    return rows.groupBy("tag").agg(F.count("v").alias("present"), F.countDistinct("v").alias("kinds"))


@query("src13_name_keys", "SELECT split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS host, count(*) AS n, count(*) FILTER (regexp_matches(url, '^https?://[^/]+/[a-z]{2}/[0-9]+')) AS good FROM pages GROUP BY 1")
def src13(spark, d):
    host = F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(1))
    return table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("url").rlike("^https?://[^/]+/[a-z]{2}/[0-9]+")).alias("good"))


@query("meta15_fold_hash", "SELECT (('0x' || substr(md5(text), 1, 8))::BIGINT % 5)::BIGINT AS fold, count(*) AS n FROM documents GROUP BY 1")
def meta15(spark, d):
    fold = F.pmod(F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long"), F.lit(5))
    return documents(spark, d).groupBy(fold.alias("fold")).agg(F.count("*").alias("n"))


@query("meta14_config_fingerprint", "SELECT source, substr(sha256('lang=' || min(lang) || ';n=' || count(*)), 1, 12) AS tag FROM documents GROUP BY source")
def meta14(spark, d):
    entries = F.array_sort(F.array(F.concat(F.lit("n="), F.count("*").cast("string")), F.concat(F.lit("lang="), F.min("lang"))))
    return documents(spark, d).groupBy("source").agg(F.substring(F.sha2(F.array_join(entries, ";"), 256), 1, 12).alias("tag"))
