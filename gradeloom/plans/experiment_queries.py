"""Folds, calibration, priors, rank ensembles and selection experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import auc, macro
from ..functions.ranks import ranked
from ..functions.resampling import bootstrap, uniform, uniform_sql
from ..operators.baseline import out_of_fold
from ..operators.folds import assign_folds, fold_report
from ..operators.stacking import shrink_first_component, stack
from ..operators.selection import TRIALS, choices, optimism, score_chosen, selection_trials
from ..sources.tables import table, written
from .base import AUCS, GOLD, RANKED, SCORED, gold, query, scored
from .metric_queries import HANLEY, REPLICATES, boot_sql, loo_logloss, r6, weights_sql

#: one row a labelled document with a fold by source number
FOLDS = "f AS (SELECT doc_id, source, lang, quality, toxic, CAST(substr(source, 4) AS BIGINT) % 5 AS fold FROM documents JOIN labels USING (doc_id))"


def folded(spark, d) -> DataFrame:
    j = table(spark, d, "documents", "doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    return j.withColumn("fold", F.substring("source", 4, 9).cast("long") % 5)


@query("fold1_assignment")
def fold1(spark, d):
    groups = folded(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))
    return assign_folds(groups, "source", "n", ["quality", "toxic"])


@query("fold2_report", f"WITH {FOLDS} SELECT fold, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, 0::BIGINT AS split FROM f GROUP BY fold")
def fold2(spark, d):
    return fold_report(folded(spark, d), "fold", "source", ["quality", "toxic"])


@query("agg25_fold_sizes", f"WITH {FOLDS}, g AS (SELECT source, count(DISTINCT fold) AS k FROM f GROUP BY source) SELECT fold, count(*) AS n, count(DISTINCT source) AS n_groups, count(*) FILTER (quality = 1) AS n_quality, count(*) FILTER (toxic = 1) AS n_toxic, count(DISTINCT source) FILTER (k > 1) AS split FROM f JOIN g USING (source) GROUP BY fold")
def agg25(spark, d):
    """Sizes, groups and positives of each fold, and its groups that another fold has as well."""
    f = folded(spark, d)
    spread = f.groupBy("source").agg(F.countDistinct("fold").alias("k"))
    cells = f.groupBy("fold", "source").agg(F.count("*").alias("c"), F.count_if(F.col("quality") == 1).alias("q"), F.count_if(F.col("toxic") == 1).alias("t")).join(spread, "source")
    return cells.groupBy("fold").agg(F.sum("c").alias("n"), F.count("*").alias("n_groups"), F.sum("q").alias("n_quality"), F.sum("t").alias("n_toxic"), F.count_if(F.col("k") > 1).alias("split"))


@query("ml1_metadata_baseline")
def ml1(spark, d):
    """AUC of labels predicted from metadata alone, out of fold: what the way of collection gives away. Null where a class has too few rows."""
    rows = table(spark, d, "documents", "doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    features = {"size": F.log1p("n_chars"), "site": F.substring("source", 4, 9).cast("double")} | {f"is_{x}": (F.col("lang") == x).cast("double") for x in ("de", "en", "es", "fr")}
    rows = rows.select("doc_id", "quality", "toxic", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in features.items()])
    return out_of_fold(rows, "doc_id", ["quality", "toxic"], list(features))


@query("fold3_group_key", "SELECT CASE WHEN n_chars > 1000 THEN source ELSE 'text_' || substr(md5(text), 1, 4) END AS grp, count(*) AS n FROM documents GROUP BY 1")
def fold3(spark, d):
    key = F.when(F.col("n_chars") > 1000, F.col("source")).otherwise(F.concat(F.lit("text_"), F.substring(F.md5("text"), 1, 4)))
    return table(spark, d, "documents").groupBy(key.alias("grp")).agg(F.count("*").alias("n"))


@query("fold5_id_sets", f"WITH {FOLDS} SELECT t.k AS fold, count(*) FILTER (f.fold <> t.k AND toxic = 0) AS n_train, count(*) FILTER (f.fold = t.k) AS n_hold FROM f, (SELECT DISTINCT fold AS k FROM f) t GROUP BY t.k")
def fold5(spark, d):
    f = folded(spark, d)
    totals = F.broadcast(f.agg(F.count_if(F.col("toxic") == 0).alias("all_")))
    k = f.groupBy("fold").agg(F.count_if(F.col("toxic") == 0).alias("own"), F.count("*").alias("n_hold"))
    return k.join(totals).select("fold", (F.col("all_") - F.col("own")).alias("n_train"), "n_hold")


def group_scores(spark, d, key: str) -> DataFrame:
    """Out-of-fold group rates as a score: the mean label of the key outside the row's fold."""
    f = folded(spark, d)
    cell = f.groupBy(key, "fold").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    both = cell.groupBy(key).agg(F.sum("k").alias("ka"), F.sum("n").alias("na"))
    p = F.coalesce(F.try_divide((F.col("ka") - F.col("k")).cast("double"), (F.col("na") - F.col("n")).cast("double")), F.lit(0.5))
    return f.join(cell.join(both, key).select(key, "fold", F.round(p, 9).alias("p")), [key, "fold"])


@query(
    "fold4_leakage",
    f"""WITH {FOLDS}, g AS (SELECT *, CASE WHEN n_lang > 1 THEN (s_lang - quality) / (n_lang - 1)::DOUBLE ELSE 0.5 END AS p1 FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n_lang, sum(quality) OVER (PARTITION BY source) AS s_lang FROM f)),
c AS (SELECT lang, fold, sum(quality) AS k, count(*) AS n FROM f GROUP BY ALL), b AS (SELECT lang, sum(k) AS ka, sum(n) AS na FROM c GROUP BY lang),
h AS (SELECT g.*, coalesce((ka - k) / nullif(na - n, 0)::DOUBLE, 0.5) AS p2 FROM g JOIN c USING (lang, fold) JOIN b USING (lang)),
r AS (SELECT quality AS y, rank() OVER (ORDER BY round(p1, 9)) + (count(*) OVER (PARTITION BY round(p1, 9)) - 1) / 2.0::DOUBLE AS r1, rank() OVER (ORDER BY round(p2, 9)) + (count(*) OVER (PARTITION BY round(p2, 9)) - 1) / 2.0::DOUBLE AS r2 FROM h)
SELECT round((sum(y * r1) - sum(y * r2)) / (sum(y) * sum(1 - y))::DOUBLE, 6) AS leak FROM r""",
)
def fold4(spark, d):
    """AUC of leave-one-out rates of the row's own source less that of out-of-fold rates of its language."""
    f = folded(spark, d)
    s = f.groupBy("source").agg(F.sum("quality").alias("s"), F.count("*").alias("n"))
    loose = f.join(s, "source").withColumn("p", F.round(F.when(F.col("n") > 1, (F.col("s") - F.col("quality")) / (F.col("n") - 1)).otherwise(0.5), 9))
    a = auc(loose.withColumn("k", F.lit("loose")), ["k"], "p", "quality").unionByName(auc(group_scores(spark, d, "lang").withColumn("k", F.lit("grouped")), ["k"], "p", "quality"))
    return a.agg(r6(F.max(F.when(F.col("k") == "loose", F.col("auc"))) - F.max(F.when(F.col("k") == "grouped", F.col("auc")))).alias("leak"))


@query(
    "fold7_recovery",
    """WITH v AS (SELECT vec_id % 7 AS study, vec_id % 5 AS fold, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
m AS (SELECT study, fold, i, avg(x + CASE WHEN fold = study % 5 THEN 0.5 ELSE 0 END) AS x FROM v GROUP BY ALL), s AS (SELECT study, i, sum(x) AS s, count(*) AS k FROM m GROUP BY ALL),
dist AS (SELECT study, fold, round(sqrt(sum(power(m.x - (s - m.x) / (k - 1), 2))), 9) AS dist FROM m JOIN s USING (study, i) GROUP BY ALL)
SELECT study, arg_max(fold, dist) AS recovered, arg_max(fold, dist) = study % 5 AS hit FROM dist GROUP BY study""",
)
def fold7(spark, d):
    """The member whose prediction vector lies farthest from the mean of the others is the one that did not train on the study."""
    v = table(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("study"), (F.col("vec_id") % 5).alias("fold"), F.posexplode("embedding").alias("i", "x"))
    planted = F.col("x").cast("double") + F.when(F.col("fold") == F.col("study") % 5, 0.5).otherwise(0.0)
    m = v.groupBy("study", "fold", "i").agg(F.avg(planted).alias("x"))
    return recover(m, ["study"], "fold").select("study", F.col("fold").alias("recovered"), (F.col("fold") == F.col("study") % 5).alias("hit"))


def recover(members: DataFrame, keys: list[str], member: str) -> DataFrame:
    """keys and the member farthest (L2) from the mean of the others; members has keys, member, i, x."""
    s = members.groupBy(*keys, "i").agg(F.sum("x").alias("_s"), F.count("*").alias("_k"))
    gap = F.col("x") - (F.col("_s") - F.col("x")) / (F.col("_k") - 1)
    dist = members.join(s, [*keys, "i"]).groupBy(*keys, member).agg(F.round(F.sqrt(F.sum(gap * gap)), 9).alias("dist"))
    return dist.groupBy(*keys).agg(F.max_by(member, "dist").alias(member))


@query("cal1_shrunk_rate", f"WITH {GOLD}, c AS (SELECT lang, label, sum(y) AS k, count(*) AS n FROM gold GROUP BY ALL), t AS (SELECT label, sum(k) / sum(n)::DOUBLE AS prior FROM c GROUP BY label) SELECT lang, label, round((k + 10 * prior) / (n + 10), 6) AS rate FROM c JOIN t USING (label)")
def cal1(spark, d):
    return shrunk(gold(spark, d), ["lang"], 10.0).select("lang", "label", r6("rate").alias("rate"))


def shrunk(rows: DataFrame, cells: list[str], m: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """label, cells and the rate (k + m * prior) / (n + m), the prior being the label's overall rate; infinite m gives the prior."""
    c = rows.groupBy(*extra, "label", *cells).agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    t = c.groupBy(*extra, "label").agg((F.sum("k") / F.sum("n")).alias("prior"))
    rate = F.col("prior") if m == float("inf") else (F.col("k") + m * F.col("prior")) / (F.col("n") + m)
    return c.join(F.broadcast(t), [*extra, "label"]).withColumn("rate", rate)


GRID = (0.0, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)


@query(
    "cal2_pick_m",
    f"""WITH {GOLD}, c AS (SELECT lang, label, sum(y)::DOUBLE AS k, count(*)::DOUBLE AS n FROM gold GROUP BY ALL), t AS (SELECT label, sum(k) AS pk, sum(n) AS pn FROM c GROUP BY label),
g AS (SELECT unnest([{', '.join(f'{m}::DOUBLE' for m in GRID)}]) AS m),
l AS (SELECT c.label, m, n, k, least(1 - 1e-6, greatest(1e-6, (k - 1 + m * (pk - 1) / (pn - 1)) / (n - 1 + m))) AS p1, least(1 - 1e-6, greatest(1e-6, (k + m * pk / (pn - 1)) / (n - 1 + m))) AS p0 FROM c JOIN t USING (label), g WHERE n > 1),
s AS (SELECT label, m, round(sum(-k * ln(p1) - (n - k) * ln(1 - p0)) / sum(n), 9) AS loss FROM l GROUP BY ALL)
SELECT label, arg_min(m, loss + m * 1e-12) AS m, round(min(loss), 6) AS loss FROM s GROUP BY label""",
)
def cal2(spark, d):
    sized = gold(spark, d).join(gold(spark, d).groupBy("lang", "label").agg(F.count("*").alias("c")).filter("c > 1").select("lang", "label"), ["lang", "label"])
    losses = None
    for m in GRID:
        part = loo_logloss(sized, ["lang"], F.lit(m)).groupBy("label").agg(F.round(F.sum("loss") / F.sum("n"), 9).alias("loss")).withColumn("m", F.lit(m))
        losses = part if losses is None else losses.unionByName(part)
    return losses.groupBy("label").agg(F.min_by("m", F.struct("loss", "m")).alias("m"), r6(F.min("loss")).alias("loss"))


CROSS = f"{GOLD}, g5 AS (SELECT *, CAST(substr(source, 4) AS BIGINT) % 5 AS fold FROM gold), x AS (SELECT k.k AS fold, lang, label, sum(y) AS s, count(*) AS n FROM g5, (SELECT unnest(range(5)) AS k) k WHERE g5.fold <> k.k GROUP BY ALL), pr AS (SELECT fold, label, sum(s) / sum(n)::DOUBLE AS prior FROM x GROUP BY ALL), fits AS (SELECT fold, lang, label, (s + 5 * prior) / (n + 5) AS rate FROM x JOIN pr USING (fold, label))"


def cross_fitted(spark, d) -> DataFrame:
    """fold, lang, label, rate fitted outside the fold: the fold's own counts taken from all counts."""
    rows = gold(spark, d).withColumn("fold", F.substring("source", 4, 9).cast("long") % 5)
    all_folds = F.array(*[F.lit(i).cast("long") for i in range(5)])
    outside = rows.groupBy("fold", "lang", "label").agg(F.sum("y").alias("y"), F.count("*").alias("c"))
    outside = outside.withColumn("k", F.explode(F.array_except(all_folds, F.array("fold"))))
    x = outside.groupBy(F.col("k").alias("fold"), "lang", "label").agg(F.sum("y").alias("s"), F.sum("c").alias("n"))
    pr = x.groupBy("fold", "label").agg((F.sum("s") / F.sum("n")).alias("prior"))
    return x.join(F.broadcast(pr), ["fold", "label"]).withColumn("rate", (F.col("s") + 5 * F.col("prior")) / (F.col("n") + 5))


@query("cal3_cross_fit", f"WITH {CROSS} SELECT fold, lang, label, round(rate, 6) AS rate FROM fits")
def cal3(spark, d):
    return cross_fitted(spark, d).select("fold", "lang", "label", r6("rate").alias("rate"))


@query("cal4_apply", f"WITH {CROSS} SELECT doc_id, g5.label, round(coalesce(rate, 0.5), 6) AS p FROM g5 LEFT JOIN fits ON fits.fold = g5.fold AND fits.lang = g5.lang AND fits.label = g5.label AND g5.lang <> 'es'")
def cal4(spark, d):
    rows = gold(spark, d).withColumn("fold", F.substring("source", 4, 9).cast("long") % 5)
    fits = cross_fitted(spark, d).filter("lang <> 'es'").select("fold", "lang", "label", "rate")  # the left-out language has no fitted rate
    return rows.join(F.broadcast(fits), ["fold", "lang", "label"], "left").select("doc_id", "label", r6(F.coalesce("rate", F.lit(0.5))).alias("p"))


PRIOR = f"{CROSS}, sc AS (SELECT doc_id, label, y, p, CAST(substr(source, 4) AS BIGINT) % 5 AS fold, lang FROM scored WHERE arm = 'c'), pri AS (SELECT sc.*, round(rate, 9) AS rate FROM sc JOIN fits USING (fold, lang, label)), prr AS (SELECT *, (rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY label) AS r, (rank() OVER (PARTITION BY fold, label ORDER BY rate) + (count(*) OVER (PARTITION BY fold, label, rate) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY fold, label) AS rp FROM pri)"
PRIOR = SCORED + PRIOR[len(GOLD):]


def prior_blend(spark, d) -> DataFrame:
    """The score's rank and the rank, inside the test fold, of the language's rate fitted outside it."""
    rows = scored(spark, d).filter("arm = 'c'").withColumn("fold", F.substring("source", 4, 9).cast("long") % 5)
    rows = rows.join(F.broadcast(cross_fitted(spark, d).select("fold", "lang", "label", F.round("rate", 9).alias("rate"))), ["fold", "lang", "label"])
    a = ranked(rows, ["label"], "p").drop("avg_rank").withColumnRenamed("pct_rank", "r")
    return ranked(a, ["fold", "label"], "rate").drop("avg_rank").withColumnRenamed("pct_rank", "rp")


@query("pri1_prior_blend", f"WITH {PRIOR} SELECT doc_id, label, round(0.9 * r + 0.1 * rp, 8) AS s FROM prr")
def pri1(spark, d):
    return prior_blend(spark, d).select("doc_id", "label", F.round(0.9 * F.col("r") + 0.1 * F.col("rp"), 8).alias("s"))


@query("pri2_unseen_groups", f"WITH {GOLD}, tr AS (SELECT source, label, avg(y) AS rate FROM gold WHERE doc_id % 3 <> 0 AND source NOT IN ('src1', 'src2') GROUP BY ALL), gl AS (SELECT label, avg(y) AS g FROM gold WHERE doc_id % 3 <> 0 GROUP BY label) SELECT gold.label, round(avg(coalesce(rate, g)), 6) AS mean, round(avg((rate IS NULL)::INTEGER), 6) AS fallback FROM gold LEFT JOIN tr USING (source, label) JOIN gl ON gl.label = gold.label WHERE doc_id % 3 = 0 GROUP BY gold.label")
def pri2(spark, d):
    rows = gold(spark, d)
    train = rows.filter("doc_id % 3 <> 0")
    rate = train.filter("source not in ('src1', 'src2')").groupBy("source", "label").agg(F.avg("y").alias("rate"))
    overall = train.groupBy("label").agg(F.avg("y").alias("g"))
    j = rows.filter("doc_id % 3 = 0").join(rate, ["source", "label"], "left").join(F.broadcast(overall), "label")
    return j.groupBy("label").agg(r6(F.avg(F.coalesce("rate", "g"))).alias("mean"), r6(F.avg(F.col("rate").isNull().cast("double"))).alias("fallback"))


@query("pri3_source_cross", f"WITH {SCORED}, pr AS (SELECT arm, label, lang, avg((p >= 0.5)::INTEGER) AS rate FROM scored GROUP BY ALL) SELECT pr.arm AS prior_arm, s.arm AS score_arm, round(avg(abs(rate - p)), 6) AS gap FROM scored s JOIN pr USING (label, lang) GROUP BY ALL")
def pri3(spark, d):
    rows = scored(spark, d)
    pr = rows.groupBy(F.col("arm").alias("prior_arm"), "label", "lang").agg(F.avg((F.col("p") >= 0.5).cast("double")).alias("rate"))
    j = rows.select(F.col("arm").alias("score_arm"), "label", "lang", "p").join(F.broadcast(pr), ["label", "lang"])
    return j.groupBy("prior_arm", "score_arm").agg(r6(F.avg(F.abs(F.col("rate") - F.col("p")))).alias("gap"))


@query("pri4_prior_table", f"WITH {GOLD} SELECT source || '|' || lang AS fingerprint, label, round(avg(y), 6) AS rate, count(*) AS n FROM gold GROUP BY ALL")
def pri4(spark, d):
    return gold(spark, d).groupBy(F.concat_ws("|", "source", "lang").alias("fingerprint"), "label").agg(r6(F.avg("y")).alias("rate"), F.count("*").alias("n"))


@query("ens1_rank_mean", f"WITH {RANKED} SELECT doc_id, label, round(avg(avg_rank), 6) AS s FROM ranked GROUP BY ALL")
def ens1(spark, d):
    return rank_mean(scored(spark, d)).select("doc_id", "label", r6("s").alias("s"))


def rank_mean(rows: DataFrame, keys: tuple[str, ...] = ("label",), rank: str = "avg_rank") -> DataFrame:
    """Mean over arms of the rank within (arm, keys)."""
    return ranked(rows, ["arm", *keys], "p").groupBy("doc_id", *keys).agg(F.avg(rank).alias("s"))


FAMILY = f"{RANKED}, fam1 AS (SELECT doc_id, label, round(avg(avg_rank), 9) AS s FROM ranked WHERE arm IN ('a', 'b') GROUP BY ALL), f1 AS (SELECT doc_id, label, (rank() OVER (PARTITION BY label ORDER BY s) + (count(*) OVER (PARTITION BY label, s) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY label) AS r1 FROM fam1), f2 AS (SELECT doc_id, label, y, avg_rank / n AS r2 FROM ranked WHERE arm = 'c'), fams AS (SELECT f1.doc_id, f1.label, y, r1, CASE WHEN f1.doc_id % 6 = 0 THEN r1 ELSE r2 END AS r2 FROM f1 JOIN f2 USING (doc_id, label))"


def families(spark, d) -> DataFrame:
    """r1: the rank of the rank mean of a and b; r2: c's rank, where c has the row, else r1."""
    rows = scored(spark, d)
    one = rank_mean(rows.filter("arm in ('a', 'b')")).withColumn("p", F.round("s", 9))
    one = ranked(one, ["label"], "p", lo=0.0, hi=float(table(spark, d, "labels").count() + 1)).select("doc_id", "label", F.col("pct_rank").alias("r1"))
    two = ranked(rows.filter("arm = 'c'"), ["label"], "p").select("doc_id", "label", "y", F.col("pct_rank").alias("r2"))
    return one.join(two, ["doc_id", "label"]).withColumn("r2", F.coalesce(F.when(F.col("doc_id") % 6 != 0, F.col("r2")), F.col("r1")))


@query("ens2_family_first", f"WITH {FAMILY} SELECT doc_id, label, round((r1 + r2) / 2, 8) AS s FROM fams")
def ens2(spark, d):
    return families(spark, d).select("doc_id", "label", F.round((F.col("r1") + F.col("r2")) / 2, 8).alias("s"))


def sweep_sql(weights) -> str:
    return f"""{FAMILY}, wts AS (SELECT unnest([{', '.join(f'{w}::DOUBLE' for w in weights)}]) AS w), mix AS (SELECT w, label, y, round((1 - w) * r1 + w * r2, 9) AS p FROM fams, wts),
mr AS (SELECT *, rank() OVER (PARTITION BY w, label ORDER BY p) + (count(*) OVER (PARTITION BY w, label, p) - 1) / 2.0::DOUBLE AS ar FROM mix),
ma AS (SELECT w, label, round((sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE, 9) AS auc FROM mr GROUP BY ALL)"""


WEIGHTS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)
FINE = tuple(round(0.05 * i, 2) for i in range(21))


def mixed(rows: DataFrame, weights) -> DataFrame:
    """rows once for each weight w, with p = (1 - w) r1 + w r2; ranks are made once, before."""
    return rows.withColumn("w", F.explode(F.array(*map(F.lit, weights)))).withColumn("p", F.round((1 - F.col("w")) * F.col("r1") + F.col("w") * F.col("r2"), 9))


@query("ens3_blend_sweep", f"WITH {sweep_sql(WEIGHTS)} SELECT w, round(avg(auc), 6) AS macro_auc FROM ma GROUP BY w")
def ens3(spark, d):
    m = macro(auc(mixed(families(spark, d), WEIGHTS), ["w", "label"]), ["w"])
    return m.select("w", r6("macro_auc").alias("macro_auc"))


@query("ens4_label_weights", f"WITH {sweep_sql(FINE)} SELECT label, w, round(auc, 6) AS auc FROM ma QUALIFY row_number() OVER (PARTITION BY label ORDER BY auc DESC, w) = 1")
def ens4(spark, d):
    return pick_weights(families(spark, d)).select("label", "w", r6("auc").alias("auc"))


def pick_weights(rows: DataFrame, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """For each key the weight of the highest AUC on the grid; the first of equal ones."""
    a = auc(mixed(rows, FINE), ["w", *keys]).withColumn("auc", F.round("auc", 9))
    best = F.max_by(F.struct("w", "auc"), F.struct("auc", -F.col("w")))
    return a.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.w", "b.auc")


HALF = "fams AS (SELECT * FROM fams0 WHERE doc_id % 2 = {k})"


def half_sql(k: int) -> str:
    return sweep_sql(FINE).replace("fams AS (SELECT f1.doc_id", "fams0 AS (SELECT f1.doc_id").replace(", wts AS", f", {HALF.format(k=k)}, wts AS", 1)


@query(
    "ens5_held_out_weights",
    f"""WITH {half_sql(0)}, pick AS (SELECT label, w FROM ma QUALIFY row_number() OVER (PARTITION BY label ORDER BY auc DESC, w) = 1),
ho AS (SELECT label, y, (rank() OVER (PARTITION BY label ORDER BY r1) + (count(*) OVER (PARTITION BY label, r1) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY label) AS q1,
    (rank() OVER (PARTITION BY label ORDER BY r2) + (count(*) OVER (PARTITION BY label, r2) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY label) AS q2 FROM fams0 WHERE doc_id % 2 = 1),
hp AS (SELECT label, y, round((1 - w) * q1 + w * q2, 9) AS p FROM ho JOIN pick USING (label)),
hr AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2.0::DOUBLE AS ar FROM hp)
SELECT label, round((sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE, 6) AS auc FROM hr GROUP BY label""",
)
def ens5(spark, d):
    rows = written(families(spark, d))
    picked = pick_weights(rows.filter("doc_id % 2 = 0")).select("label", "w")
    held = rows.filter("doc_id % 2 = 1").withColumns({"r1": F.round("r1", 12), "r2": F.round("r2", 12)})
    held = ranked(held, ["label"], "r1").drop("avg_rank", "r1").withColumnRenamed("pct_rank", "q1")
    held = ranked(held, ["label"], "r2").drop("avg_rank", "r2").withColumnRenamed("pct_rank", "q2")
    p = F.round((1 - F.col("w")) * F.col("q1") + F.col("w") * F.col("q2"), 9)
    return auc(held.join(F.broadcast(picked), "label").withColumn("p", p), ["label"]).select("label", r6("auc").alias("auc"))


@query(
    "ens6_bagged_weights",
    f"""WITH {sweep_sql(FINE)}, {weights_sql(25, "SELECT DISTINCT doc_id FROM fams")}, cells AS (SELECT w, label, rep, p, sum(weights.w_ * y)::DOUBLE AS pos, sum(weights.w_ * (1 - y))::DOUBLE AS neg FROM mix JOIN weights USING (doc_id) WHERE weights.w_ > 0 GROUP BY ALL),
steps AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY w, label, rep ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM cells),
boot AS (SELECT w, label, rep, round(sum(pos * (neg_below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 9) AS auc FROM steps GROUP BY ALL),
pick AS (SELECT rep, label, w FROM boot QUALIFY row_number() OVER (PARTITION BY rep, label ORDER BY auc DESC, w) = 1) SELECT label, count(*) AS bags, round(avg(w), 6) AS w, round(stddev_pop(w), 6) AS sd FROM pick GROUP BY label""".replace("AS w FROM (SELECT doc_id, rep", "AS w_ FROM (SELECT doc_id, rep").replace("mix AS (SELECT w, label, y,", "mix AS (SELECT w, doc_id, label, y,"),
)
def ens6(spark, d):
    """The mean of the weights that 25 resamples choose; a resample's weights are one array a row."""
    boot = bootstrap(mixed(families(spark, d), FINE), ["w", "label"], "doc_id", 25).withColumn("auc", F.round("auc", 9))
    picked = boot.groupBy("rep", "label").agg(F.max_by("w", F.struct("auc", -F.col("w"))).alias("w"))
    return picked.groupBy("label").agg(F.count("*").alias("bags"), r6(F.avg("w")).alias("w"), r6(F.stddev_pop("w")).alias("sd"))


@query(
    "ens7_selection_optimism",
    f"""WITH {FAMILY}, ids AS (SELECT DISTINCT doc_id FROM fams), draws AS (SELECT doc_id, trial, row_number() OVER (PARTITION BY trial ORDER BY {uniform_sql('doc_id', f'(trial + {TRIALS})')}, doc_id) AS place FROM ids, range(200) t(trial)),
sets AS (SELECT doc_id, trial, size, place <= size AS sel FROM draws, (SELECT unnest([58, 150, 400, 1000, 2500])::INTEGER AS size) WHERE size < (SELECT count(*) FROM ids)),
wts AS (SELECT unnest([{', '.join(f'{w}::DOUBLE' for w in FINE)}]) AS w), mix AS (SELECT w, doc_id, label, y, round((1 - w) * r1 + w * r2, 9) AS p FROM fams, wts),
ord AS (SELECT w, trial, size, sel, label, y, rank() OVER (PARTITION BY w, trial, size, sel, label ORDER BY p) + (count(*) OVER (PARTITION BY w, trial, size, sel, label, p) - 1) / 2.0::DOUBLE AS ar FROM mix JOIN sets USING (doc_id)),
ma AS (SELECT w, trial, size, sel, label, (sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE AS auc FROM ord GROUP BY ALL),
pick AS (SELECT trial, size, label, CASE WHEN auc IS NULL THEN 0 ELSE w END AS w FROM ma WHERE sel QUALIFY row_number() OVER (PARTITION BY trial, size, label ORDER BY round(auc, 9) DESC NULLS LAST, w) = 1),
g AS (SELECT p.trial, p.size, avg(auc) FILTER (sel AND ma.w = p.w) - avg(auc) FILTER (sel AND ma.w = 0) AS claimed, avg(auc) FILTER (NOT sel AND ma.w = p.w) - avg(auc) FILTER (NOT sel AND ma.w = 0) AS realised FROM pick p JOIN ma USING (trial, size, label) GROUP BY p.trial, p.size)
SELECT size, count(*) AS trials, round(avg(claimed), 6) AS claimed, round(avg(realised), 6) AS realised, round(avg(claimed - realised), 6) AS optimism, round(avg((round(realised, 9) <= 0)::INTEGER), 6) AS p_no_gain,
    {', '.join(f'round(avg((round(claimed, 9) >= {x})::INTEGER), 6) AS p_claimed_{n}' for x, n in ((0.01, '0100'), (0.02, '0200'), (0.0273, '0273')))} FROM g WHERE claimed IS NOT NULL AND realised IS NOT NULL GROUP BY size""",
)
def ens7(spark, d):
    """Weights a label, chosen on 58 to 2,500 documents in 200 trials: what they claim there and gain on all other documents, with tail probabilities."""
    return optimism(selection_trials(families(spark, d), "doc_id")[0])


@query("ens7_bagged_selection")
def ens7_bagged(spark, d):
    """The same with the mean of the weights of 25 resamples of each drawn set."""
    rows = written(families(spark, d))
    chosen, sets = choices(rows, "doc_id", bags=25)
    return optimism(score_chosen(rows, "doc_id", chosen, sets, "w_bagged"))


@query("ens9_pooling_rules", f"WITH {SCORED}, w AS (SELECT doc_id, label, max(p) FILTER (arm = 'a') AS a, max(p) FILTER (arm = 'b') AS b FROM scored GROUP BY ALL) SELECT doc_id, label, round(CASE label WHEN 'quality' THEN greatest(a, b) ELSE (a + b) / 2 END, 9) AS p FROM w")
def ens9(spark, d):
    rules = spark.createDataFrame([("quality", "max"), ("toxic", "mean")], "label string, rule string")
    w = scored(spark, d).groupBy("doc_id", "label").pivot("arm", ["a", "b"]).agg(F.first("p")).join(F.broadcast(rules), "label")
    p = F.when(F.col("rule") == "max", F.greatest("a", "b")).when(F.col("rule") == "A", F.col("a")).otherwise((F.col("a") + F.col("b")) / 2)
    return w.select("doc_id", "label", F.round(p, 9).alias("p"))


@query("ens10_window_pooling", f"WITH {SCORED} SELECT doc_id, label, round(CASE WHEN any_value(label) = 'toxic' THEN max(q) ELSE 1 / (1 + exp(-avg(ln(q / (1 - q))))) END, 8) AS p FROM (SELECT *, least(1 - 1e-6, greatest(1e-6, p)) AS q FROM scored) GROUP BY doc_id, label")
def ens10(spark, d):
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("p")))
    g = scored(spark, d).groupBy("doc_id", "label").agg(F.max(q).alias("top"), F.avg(F.log(q / (1 - q))).alias("logit"))
    return g.select("doc_id", "label", F.round(F.when(F.col("label") == "toxic", F.col("top")).otherwise(1 / (1 + F.exp(-F.col("logit")))), 8).alias("p"))


@query("ens11_view_mean", f"WITH {SCORED} SELECT doc_id, label, round(avg(CASE WHEN (doc_id + ascii(arm)) % 3 <> 0 THEN p END), 9) AS p FROM scored GROUP BY ALL")
def ens11(spark, d):
    seen = F.when((F.col("doc_id") + F.ascii("arm")) % 3 != 0, F.col("p"))
    return scored(spark, d).groupBy("doc_id", "label").agg(F.round(F.avg(seen), 9).alias("p"))


@query("ens12_strength_bar", f"WITH {AUCS}, m AS (SELECT arm, avg(auc) AS m, sqrt(sum(se * se)) / count(*) AS se FROM (SELECT *, {HANLEY} AS se FROM aucs) GROUP BY arm) SELECT arm, CASE WHEN m >= 0.55 THEN 'PASS' ELSE 'PARK' END AS verdict FROM m")
def ens12(spark, d):
    m = macro(auc(scored(spark, d), ["arm", "label"]), ["arm"])
    return m.select("arm", F.when(F.col("macro_auc") >= 0.55, "PASS").otherwise("PARK").alias("verdict"))


def family_macro_sql(name: str, arms: str) -> str:
    return f"""f_{name} AS (SELECT doc_id, label, any_value(y) AS y, round(avg(avg_rank / n), 9) AS p FROM ranked WHERE arm IN ({arms}) GROUP BY doc_id, label),
c_{name} AS (SELECT label, rep, p, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM f_{name} JOIN weights USING (doc_id) WHERE w > 0 GROUP BY ALL),
s_{name} AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY label, rep ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM c_{name}),
b_{name} AS (SELECT rep, avg(auc) AS m FROM (SELECT label, rep, sum(pos * (neg_below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM s_{name} GROUP BY ALL) GROUP BY rep)"""


@query(
    "ens12_family_delta",
    f"""WITH {RANKED}, {weights_sql(REPLICATES)}, {family_macro_sql('two', "'a', 'c'")}, {family_macro_sql('three', "'a', 'b', 'c'")}
SELECT round(avg(three.m - two.m), 5) AS delta, round(stddev_pop(three.m - two.m), 5) AS sd, round(avg((three.m > two.m)::INTEGER), 5) AS p_better FROM b_three three JOIN b_two two USING (rep)""",
)
def ens12_families(spark, d):
    """What a third family adds to the rank mean of two, by a paired bootstrap."""
    r = ranked(scored(spark, d), ["arm", "label"], "p").select("doc_id", "label", "y", "arm", "pct_rank")
    sets = F.explode(F.when(F.col("arm") == "b", F.array(F.lit("three"))).otherwise(F.array(F.lit("two"), F.lit("three"))))
    p = r.withColumn("set", sets).groupBy("set", "doc_id", "label", "y").agg(F.round(F.avg("pct_rank"), 9).alias("p"))
    m = macro(bootstrap(p, ["set", "label"], "doc_id", REPLICATES), ["set", "rep"]).groupBy("rep").pivot("set", ["two", "three"]).agg(F.first("macro_auc"))
    delta = F.col("three") - F.col("two")
    return m.agg(F.round(F.avg(delta), 5).alias("delta"), F.round(F.stddev_pop(delta), 5).alias("sd"), F.round(F.avg((delta > 0).cast("double")), 5).alias("p_better"))


@query("ml2_stacker")
def ml2(spark, d):
    """Macro area of a label's own score, of the same after the first principal component of all labels' logits was shrunk, and of a stacker over all labels' scores, fitted outside each row's fold."""
    own = scored(spark, d).filter("arm = 'c'").groupBy("doc_id").pivot("label", ["quality", "toxic"]).agg(F.first("p"))
    more = scored(spark, d).filter("arm = 'b'").groupBy("doc_id").pivot("label", ["quality", "toxic"]).agg(F.first("p")).toDF("doc_id", "quality_b", "toxic_b")
    labels = folded(spark, d).select("doc_id", F.col("quality").alias("y_quality"), F.col("toxic").alias("y_toxic"), "fold")
    rows = written(own.join(more, "doc_id").join(labels, "doc_id"))
    scores = ["quality", "toxic", "quality_b", "toxic_b"]
    shrunk, share = shrink_first_component(rows, scores, 0.5)
    stacked = stack(rows, scores, ["quality", "toxic"], "fold")
    long = lambda df, how: df.select(F.lit(how).alias("method"), F.inline(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"y_{n}").alias("y"), F.col(n).alias("p")) for n in ("quality", "toxic")])))
    every = long(rows, "own").unionByName(long(shrunk, "shrunk")).unionByName(long(stacked, "stacked"))
    return macro(auc(every, ["method", "label"], parts=64), ["method"]).select("method", r6("macro_auc").alias("macro_auc"), F.round(F.lit(share), 6).alias("first_share"))


@query("ens13_tie_band", f"WITH {AUCS}, m AS (SELECT arm, avg(auc) AS m FROM aucs GROUP BY arm) SELECT x.arm AS arm_1, z.arm AS arm_2, CASE WHEN abs(x.m - z.m) <= 0.02 THEN 'tie' WHEN x.m > z.m THEN 'first' ELSE 'second' END AS verdict FROM m x JOIN m z ON x.arm < z.arm")
def ens13(spark, d):
    m = macro(auc(scored(spark, d), ["arm", "label"]), ["arm"])
    a, b = (m.select(F.col("arm").alias(f"arm_{i}"), F.col("macro_auc").alias(f"m{i}")) for i in (1, 2))
    j = a.join(F.broadcast(b), F.col("arm_1") < F.col("arm_2"))  # a row a source
    return j.select("arm_1", "arm_2", F.when(F.abs(F.col("m1") - F.col("m2")) <= 0.02, "tie").when(F.col("m1") > F.col("m2"), "first").otherwise("second").alias("verdict"))



MEMBERS = "mem AS (SELECT doc_id, label, y, p, CASE arm WHEN 'a' THEN 0 WHEN 'b' THEN 1 ELSE 2 END AS member FROM scored)"


def members(spark, d) -> DataFrame:
    """Scores by member number; member doc_id % 3 is the one that did not see the document."""
    return scored(spark, d).withColumn("member", F.when(F.col("arm") == "a", 0).when(F.col("arm") == "b", 1).otherwise(2))


@query("fold6_held_out_member", f"WITH {SCORED}, {MEMBERS} SELECT doc_id, label, round(avg(p), 9) AS p FROM mem WHERE member = doc_id % 3 GROUP BY ALL")
def fold6(spark, d):
    return members(spark, d).filter(F.col("member") == F.col("doc_id") % 3).groupBy("doc_id", "label").agg(F.round(F.avg("p"), 9).alias("p"))


@query(
    "met20_inflation",
    f"""WITH {SCORED}, {MEMBERS}, v AS (SELECT 'all' AS kind, doc_id, label, any_value(y) AS y, round(avg(p), 9) AS p FROM mem GROUP BY doc_id, label UNION ALL SELECT 'held', doc_id, label, any_value(y), round(avg(p), 9) FROM mem WHERE member = doc_id % 3 GROUP BY doc_id, label),
r AS (SELECT *, rank() OVER (PARTITION BY kind, label ORDER BY p) + (count(*) OVER (PARTITION BY kind, label, p) - 1) / 2.0::DOUBLE AS ar FROM v),
a AS (SELECT kind, label, (sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE AS auc FROM r GROUP BY ALL)
SELECT round(avg(auc) FILTER (kind = 'all') - avg(auc) FILTER (kind = 'held'), 6) AS inflation FROM a""",
)
def met20(spark, d):
    """Macro AUC of the mean over all members less that of the members that did not see the document."""
    m = members(spark, d)
    mean = lambda rows, kind: rows.groupBy("doc_id", "label", "y").agg(F.round(F.avg("p"), 9).alias("p")).withColumn("kind", F.lit(kind))
    a = auc(mean(m, "all").unionByName(mean(m.filter(F.col("member") == F.col("doc_id") % 3), "held")), ["kind", "label"])
    side = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("auc")))
    return a.agg(r6(side("all") - side("held")).alias("inflation"))


SITE = "CAST(substr(source, 4) AS BIGINT) % 5"


RANDOM_FOLD = f"CAST(floor({uniform_sql('doc_id', '77')} * 5) AS INTEGER)"


@query(
    "ens8_fold_schemes",
    f"""WITH {sweep_sql(FINE).replace("fams AS (SELECT f1.doc_id", "fams0 AS (SELECT f1.doc_id").replace(", wts AS", f", sited AS (SELECT fams0.*, CAST({SITE} AS INTEGER) AS site, {RANDOM_FOLD} AS part FROM fams0 JOIN documents USING (doc_id)), outer_ AS (SELECT unnest(range(5))::INTEGER AS fold), fams AS (SELECT 'site' AS scheme, fold, sited.* FROM sited, outer_ WHERE site <> fold UNION ALL SELECT 'random', fold, sited.* FROM sited, outer_ WHERE site <> fold AND part <> fold), wts AS", 1).replace("mix AS (SELECT w, label, y,", "mix AS (SELECT w, scheme, fold, label, y,").replace("PARTITION BY w, label", "PARTITION BY w, scheme, fold, label").replace("ma AS (SELECT w, label,", "ma AS (SELECT w, scheme, fold, label,")},
pick AS (SELECT scheme, fold, label, CASE WHEN auc IS NULL THEN 0 ELSE w END AS w FROM ma QUALIFY row_number() OVER (PARTITION BY scheme, fold, label ORDER BY auc DESC NULLS LAST, w) = 1),
hp AS (SELECT scheme, fold, label, y, round((1 - w) * r1 + w * r2, 9) AS p FROM sited JOIN pick USING (label) WHERE site = fold
    UNION ALL SELECT scheme, -1, label, y, round((1 - w) * r1 + w * r2, 9) FROM sited, (SELECT unnest(['first', 'half', 'second']) AS scheme, unnest([0.0, 0.5, 1.0])::DOUBLE AS w)),
hr AS (SELECT *, rank() OVER (PARTITION BY scheme, fold, label ORDER BY p) + (count(*) OVER (PARTITION BY scheme, fold, label, p) - 1) / 2.0::DOUBLE AS ar FROM hp),
ha AS (SELECT scheme, fold, label, count(*) AS n, (sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE AS auc FROM hr GROUP BY ALL)
SELECT scheme, fold, max(n) AS n, round(avg(auc), 6) AS macro_auc FROM ha GROUP BY ALL""",
)
def ens8(spark, d):
    """Nested selection: for each site held out, weights picked on the other sites, or on a random scheme's other parts without that site's documents; both scored on the site. Fold -1: fixed weights on all."""
    site = F.substring("source", 4, 9).cast("long") % 5
    rows = written(families(spark, d).join(table(spark, d, "documents", "doc_id", "source"), "doc_id").withColumns({"site": site.cast("int"), "part": F.floor(uniform(F.col("doc_id"), F.lit(77)) * 5).cast("int")}))
    dev = rows.withColumn("fold", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(4)), F.array("site"))))
    dev = dev.withColumn("scheme", F.explode(F.when(F.col("part") != F.col("fold"), F.array(F.lit("site"), F.lit("random"))).otherwise(F.array(F.lit("site")))))
    picked = pick_weights(dev, ("scheme", "fold", "label")).select("scheme", "fold", "label", F.when(F.col("auc").isNotNull(), F.col("w")).otherwise(0.0).alias("w"))
    held = rows.withColumnRenamed("site", "fold").join(F.broadcast(picked), ["fold", "label"]).select("scheme", "fold", "label", "y", "r1", "r2", "w")  # a row a scheme, site and label
    fixed = F.explode(F.array(*[F.struct(F.lit(n).alias("scheme"), F.lit(-1).alias("fold"), F.lit(w).alias("w")) for n, w in (("first", 0.0), ("half", 0.5), ("second", 1.0))]))
    held = held.unionByName(rows.select("label", "y", "r1", "r2", fixed.alias("f")).select("label", "y", "r1", "r2", "f.*"))
    a = auc(held.withColumn("p", F.round((1 - F.col("w")) * F.col("r1") + F.col("w") * F.col("r2"), 9)), ["scheme", "fold", "label"])
    return a.groupBy("scheme", "fold").agg(F.max(F.col("n_pos") + F.col("n_neg")).alias("n"), r6(F.avg("auc")).alias("macro_auc"))


def noise_sql(name: str, where: str) -> str:
    cte = boot_sql().split("cells AS", 1)[1].replace("WHERE w > 0", f"WHERE w > 0 {where}")
    for x in ("cells", "steps", "boot", "macros"):
        cte = cte.replace(f"FROM {x}", f"FROM {x}_{name}").replace(f"{x} AS (", f"{x}_{name} AS (")
    return f"cells_{name} AS" + cte


def level_sql(name: str, where: str) -> str:
    return f"""ar_{name} AS (SELECT *, rank() OVER (PARTITION BY arm, label ORDER BY p) + (count(*) OVER (PARTITION BY arm, label, p) - 1) / 2.0::DOUBLE AS ar FROM scored {where}),
level_{name} AS (SELECT arm, avg(auc) AS m FROM (SELECT arm, label, (sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE AS auc FROM ar_{name} GROUP BY ALL) GROUP BY arm)"""


@query(
    "ens14_instruments",
    f"""WITH {boot_sql().split('cells AS', 1)[0]}{noise_sql('few', 'AND doc_id % 5 = 0')}, {noise_sql('all', '')}, {level_sql('few', 'WHERE doc_id % 5 = 0')}, {level_sql('all', '')},
s AS (SELECT arm, stddev_pop(macro_auc) AS sd FROM macros_few GROUP BY arm), z AS (SELECT arm, stddev_pop(macro_auc) AS sd FROM macros_all GROUP BY arm)
SELECT arm, round(s.sd, 5) AS sd_few, round(z.sd, 5) AS sd_all, round(s.sd / z.sd, 3) AS ratio, round(abs(level_few.m - level_all.m), 6) AS level_difference FROM s JOIN z USING (arm) JOIN level_few USING (arm) JOIN level_all USING (arm)""",
)
def ens14(spark, d):
    """How much noisier a fifth of the documents is than all of them, as a ratio of bootstrap deviations, and how far their levels are apart."""
    rows = scored(spark, d)

    def instrument(df, name):
        sd = macro(bootstrap(df, ["arm", "label"], "doc_id", REPLICATES), ["arm", "rep"]).groupBy("arm").agg(F.stddev_pop("macro_auc").alias(f"sd_{name}"))
        return sd.join(macro(auc(df, ["arm", "label"]), ["arm"]).select("arm", F.col("macro_auc").alias(f"m_{name}")), "arm")

    j = instrument(rows.filter("doc_id % 5 = 0"), "few").join(instrument(rows, "all"), "arm")
    r = lambda c, n: F.round(c, n)
    return j.select("arm", r("sd_few", 5).alias("sd_few"), r("sd_all", 5).alias("sd_all"), r(F.try_divide("sd_few", "sd_all"), 3).alias("ratio"), r6(F.abs(F.col("m_few") - F.col("m_all"))).alias("level_difference"))
