"""Ordered operators, top-k and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import numbered
from ..sources.tables import table
from .base import SCORED, documents, query, scored
from .metric_queries import r6

EV = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def ordered_events(spark, d) -> DataFrame:
    """events with the position i (from 0) and the number n of each user's events."""
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events")
    return e.withColumns({"i": (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long"), "n": F.count("*").over(w)})


def order_hash(key: Column, seed: int) -> Column:
    """A pseudo-random order of integer keys by integer arithmetic, so that every engine draws the same rows."""
    return F.pmod(key * 1103515245 + seed * 12345, F.lit(2147483647))


HASH = "(({} * 1103515245 + {} * 12345) % 2147483647)"


@query("win1_best_per_slot", "SELECT user_id, event_type, event_id FROM events WHERE event_type IN ('click', 'view', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def win1(spark, d):
    best = F.max_by("event_id", F.struct("value", -F.col("event_id")))
    return table(spark, d, "events").filter(F.col("event_type").isin("click", "view", "purchase")).groupBy("user_id", "event_type").agg(best.alias("event_id"))


@query("win2_first_match", "SELECT user_id, event_id FROM events WHERE value > 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def win2(spark, d):
    return table(spark, d, "events").filter("value > 50").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("win4_neighbours", f"WITH {EV} SELECT event_id, coalesce(lag(event_id) OVER w, event_id) AS prev, coalesce(lead(event_id) OVER w, event_id) AS next FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win4(spark, d):
    w, x = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.col("event_id")
    return table(spark, d, "events").select("event_id", F.coalesce(F.lag(x).over(w), x).alias("prev"), F.coalesce(F.lead(x).over(w), x).alias("next"))


@query(
    "win5_fill_nearest",
    f"""WITH {EV}, v AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_id END AS x FROM e),
b AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER w AS lo, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER z AS hi, last_value(x IGNORE NULLS) OVER w AS xl, first_value(x IGNORE NULLS) OVER z AS xh FROM v
    WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, CASE WHEN lo IS NULL THEN xh WHEN hi IS NULL THEN xl WHEN i - lo <= hi - i THEN xl ELSE xh END AS filled FROM b WHERE lo IS NOT NULL OR hi IS NOT NULL""",
)
def win5(spark, d):
    e = ordered_events(spark, d).withColumn("x", F.when(F.col("event_id") % 3 == 0, F.col("event_id")))
    return fill_nearest(e, ["user_id"], "i", "x").filter("filled is not null").select("event_id", "filled")


def fill_nearest(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Adds ``filled``: the value, or that of the nearest row by position that has one (the earlier of two as near); null if none has."""
    w = Window.partitionBy(*keys).orderBy(position)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(position))
    lo, hi = F.last(at, True).over(back), F.first(at, True).over(ahead)
    xl, xh = F.last(value, True).over(back), F.first(value, True).over(ahead)
    p = F.col(position)
    return df.withColumn("filled", F.when(lo.isNull(), xh).when(hi.isNull(), xl).when(p - lo <= hi - p, xl).otherwise(xh))


@query("win6_even_sample", f"WITH {EV} SELECT DISTINCT user_id, event_id FROM e, range(5) t(j) WHERE i = round_even(j * (n - 1) / 4.0::DOUBLE, 0)")
def win6(spark, d):
    spots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.bround(j * (F.col("n") - 1) / 4.0).cast("long")))
    return ordered_events(spark, d).filter(F.array_contains(spots, F.col("i"))).select("user_id", "event_id")


@query("win7_central_band", f"WITH {EV} SELECT DISTINCT user_id, event_id FROM e, range(4) t(j) WHERE i = floor(0.25 * (n - 1) + j * (0.5 * (n - 1)) / 3)")
def win7(spark, d):
    n1 = F.col("n") - 1
    spots = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.floor(0.25 * n1 + j * (0.5 * n1) / 3))
    return ordered_events(spark, d).filter(F.array_contains(spots, F.col("i"))).select("user_id", "event_id")


@query("win8_sliding_windows", f"WITH {EV} SELECT user_id, s AS start, round(avg(value), 6) AS mean FROM e, LATERAL (SELECT unnest(range(greatest(0, i - 2), least(i, n - 3) + 1)) AS s) GROUP BY ALL")
def win8(spark, d):
    start = F.explode(F.when(F.col("n") >= 3, F.sequence(F.greatest(F.lit(0).cast("long"), F.col("i") - 2), F.least("i", F.col("n") - 3))).otherwise(F.array().cast("array<long>")))
    ok = ordered_events(spark, d).filter("greatest(0, i - 2) <= least(i, n - 3)")
    return ok.select("user_id", "value", start.alias("start")).groupBy("user_id", "start").agg(r6(F.avg("value")).alias("mean"))


@query("win13_top2_mean", f"WITH {SCORED}, t AS (SELECT doc_id, label, p FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY p DESC, arm) <= 2) SELECT doc_id, label, round(avg(p), 9) AS top2, round(max(p), 9) AS best FROM t GROUP BY ALL")
def win13(spark, d):
    top = F.slice(F.sort_array(F.collect_list("p"), asc=False), 1, 2)
    return scored(spark, d).groupBy("doc_id", "label").agg(F.round(F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top), 9).alias("top2"), F.round(F.max("p"), 9).alias("best"))


@query("win14_item_ids", f"SELECT doc_id, format('it{{:04d}}', row_number() OVER (ORDER BY {HASH.format('doc_id', 1)}, doc_id) - 1) AS item_id FROM labels")
def win14(spark, d):
    """Positions in a seeded shuffle, numbered within ranges of the order."""
    rows = numbered(table(spark, d, "labels", "doc_id"), order_hash(F.col("doc_id"), 1), ["doc_id"], 0, 2**31)
    return rows.select("doc_id", F.format_string("it%04d", "_n").alias("item_id"))


@query("win16_first_middle_last", f"WITH {EV} SELECT user_id, event_id, i FROM e WHERE i IN (0, n // 2, n - 1)")
def win16(spark, d):
    return ordered_events(spark, d).filter("i in (0, n div 2, n - 1)").select("user_id", "event_id", "i")


@query("top1_tokens", "SELECT tok, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS tok FROM documents WHERE lang = 'en') GROUP BY tok ORDER BY n DESC, tok LIMIT 60")
def top1(spark, d):
    tok = F.explode(F.regexp_extract_all("text", F.lit("([a-z]+)"), 1))
    return documents(spark, d).filter("lang = 'en'").select(tok.alias("tok")).groupBy("tok").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tok").limit(60)


@query("top2_weakest_sources", "SELECT source, round(avg(quality), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(*) >= 5 ORDER BY rate, source LIMIT 3")
def top2(spark, d):
    j = table(spark, d, "documents", "doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("source").agg(r6(F.avg("quality")).alias("rate"), F.count("*").alias("n")).filter("n >= 5").drop("n").orderBy("rate", "source").limit(3)


@query("top3_limit_keeping_gold", "SELECT doc_id FROM labels UNION SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50)")
def top3(spark, d):
    return table(spark, d, "labels", "doc_id").union(table(spark, d, "documents", "doc_id").orderBy("doc_id").limit(50)).distinct()


@query("top4_best_configuration", f"WITH {SCORED} SELECT label, max_by(arm, m) AS best FROM (SELECT label, arm, avg(abs(y - p)) AS m FROM scored GROUP BY ALL) GROUP BY label")
def top4(spark, d):
    m = scored(spark, d).groupBy("label", "arm").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("m"))
    return m.groupBy("label").agg(F.max_by("arm", "m").alias("best"))


ALLOC = """c AS (SELECT lang, count(*) AS avail FROM documents GROUP BY lang), t AS (SELECT sum(avail) AS total FROM c),
alloc AS (SELECT lang, avail, least(avail, CASE WHEN lang = 'en' THEN 60 ELSE 1000000 END, greatest(CASE WHEN avail >= 50 THEN 20 ELSE 0 END, round_even(250.0::DOUBLE * avail / total, 0)))::BIGINT AS take FROM c, t)"""


def allocation(strata: DataFrame, total: int, floor: int = 20, floor_from: int = 50, capped: str | None = None, cap: int = 60) -> DataFrame:
    """(lang, avail) with ``take``: the proportional share rounded half to even, at least ``floor`` where enough rows are there, at most the cap and what there is."""
    all_ = F.broadcast(strata.agg(F.sum("avail").alias("_all")))  # one row
    share = F.greatest(F.when(F.col("avail") >= floor_from, floor).otherwise(0), F.bround(float(total) * F.col("avail") / F.col("_all")))
    return strata.join(all_).withColumn("take", F.least("avail", F.when(F.col("lang") == capped, cap).otherwise(1_000_000), share).cast("long")).drop("_all")


@query("smp1_allocation", f"WITH {ALLOC} SELECT lang, avail, take FROM alloc")
def smp1(spark, d):
    return allocation(documents(spark, d).groupBy("lang").agg(F.count("*").alias("avail")), 250, capped="en")


def first_by_hash(df: DataFrame, key: str, keys: list[str], seed: int, take: Column | str) -> DataFrame:
    """The ``take`` rows of each group that come first in the seeded order.

    Rows are first thinned within slices of the order, which are dealt to many tasks, so that no task sorts a whole group.
    """
    h = order_hash(F.col(key), seed)
    take = F.col(take) if isinstance(take, str) else take
    df = df.withColumns({"_h": h, "_s": F.pmod(F.xxhash64(key), F.lit(64))})
    part = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("_h", key))).filter(F.col("_r") <= take)
    return part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", key))).filter(F.col("_r") <= take).drop("_h", "_s", "_r")


@query("smp2_stratified_draw", f"WITH {ALLOC} SELECT lang, doc_id FROM documents JOIN alloc USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {HASH.format('doc_id', 2)}, doc_id) <= take")
def smp2(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang")
    return first_by_hash(docs.join(F.broadcast(smp1(spark, d)), "lang"), "doc_id", ["lang"], 2, "take").select("lang", "doc_id")


@query(
    "smp3_blind_mix",
    f"""WITH g AS (SELECT doc_id FROM labels ORDER BY {HASH.format('doc_id', 3)}, doc_id LIMIT 30), r AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY {HASH.format('doc_id', 4)}, doc_id LIMIT 60),
m AS (SELECT doc_id, true AS is_gold FROM g UNION ALL SELECT doc_id, false FROM r), dup AS (SELECT doc_id FROM m ORDER BY {HASH.format('doc_id', 5)}, doc_id LIMIT 20)
SELECT doc_id, is_gold, NULL::BIGINT AS dup_of FROM m UNION ALL SELECT -doc_id - 1, is_gold, doc_id FROM m WHERE doc_id IN (SELECT doc_id FROM dup)""",
)
def smp3(spark, d):
    draw = lambda df, seed, n: df.orderBy(order_hash(F.col("doc_id"), seed), "doc_id").limit(n)
    labels, docs = table(spark, d, "labels", "doc_id"), table(spark, d, "documents", "doc_id")
    m = draw(labels, 3, 30).withColumn("is_gold", F.lit(True)).union(draw(docs.join(labels, "doc_id", "left_anti"), 4, 60).withColumn("is_gold", F.lit(False)))
    planted = draw(m, 5, 20).select((-F.col("doc_id") - 1).alias("doc_id"), "is_gold", F.col("doc_id").alias("dup_of"))
    return m.withColumn("dup_of", F.lit(None).cast("long")).unionByName(planted)


@query("smp4_equal_quota", f"SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {HASH.format('event_id', 6)}, event_id) <= 40")
def smp4(spark, d):
    return first_by_hash(table(spark, d, "events").select("event_type", "event_id"), "event_id", ["event_type"], 6, F.lit(40))


@query("smp5_subset_and_complement", f"WITH s AS (SELECT trial, doc_id FROM labels, range(3) t(trial) QUALIFY row_number() OVER (PARTITION BY trial ORDER BY {HASH.format('doc_id', '(trial + 10)')}, doc_id) <= 25) SELECT trial, doc_id, EXISTS (SELECT 1 FROM s WHERE s.trial = t.trial AND s.doc_id = l.doc_id) AS chosen FROM labels l, range(3) t(trial)")
def smp5(spark, d):
    rows = table(spark, d, "labels", "doc_id").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("trial"))
    rows = rows.withColumn("_h", F.pmod(F.col("doc_id") * 1103515245 + (F.col("trial") + 10) * 12345, F.lit(2147483647)))
    first = lambda df, *keys: df.withColumn("_r", F.row_number().over(Window.partitionBy("trial", *keys).orderBy("_h", "doc_id"))).filter("_r <= 25")
    chosen = first(first(rows.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(64))), "_s"))  # thinned in slices first
    chosen = F.broadcast(chosen.select("trial", "doc_id", F.lit(True).alias("chosen")))  # 25 rows a trial
    return rows.join(chosen, ["trial", "doc_id"], "left").select("trial", "doc_id", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query("smp6_random_folds", f"SELECT {HASH.format('doc_id', 7)} % 5 AS fold, count(*) AS n FROM labels GROUP BY 1")
def smp6(spark, d):
    return table(spark, d, "labels").groupBy(F.pmod(order_hash(F.col("doc_id"), 7), F.lit(5)).alias("fold")).agg(F.count("*").alias("n"))


@query("smp7_child_dropout", f"SELECT user_id, event_id FROM events QUALIFY {HASH.format('event_id', 8)} % 10 >= 4 OR row_number() OVER (PARTITION BY user_id ORDER BY {HASH.format('event_id', 8)}, event_id) = 1")
def smp7(spark, d):
    e = table(spark, d, "events").withColumn("h", order_hash(F.col("event_id"), 8))
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("h", "event_id"))
    return e.withColumn("rn", first).filter((F.col("h") % 10 >= 4) | (F.col("rn") == 1)).select("user_id", "event_id")


@query("smp8_scramble", f"WITH {EV} SELECT event_id, n - 1 - i AS reversed, row_number() OVER (PARTITION BY user_id ORDER BY {HASH.format('event_id', 9)}, event_id) - 1 AS shuffled FROM e")
def smp8(spark, d):
    s = F.row_number().over(Window.partitionBy("user_id").orderBy(order_hash(F.col("event_id"), 9), "event_id"))
    return ordered_events(spark, d).select("event_id", (F.col("n") - 1 - F.col("i")).alias("reversed"), (s - 1).cast("long").alias("shuffled"))
