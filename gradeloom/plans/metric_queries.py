"""Rank metrics, intervals, resampling and error budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.metrics import auc, balanced_accuracy, hanley_se, macro, wilson
from ..functions.ranks import corr, ranked
from ..functions.resampling import CUTS_SQL, bootstrap, uniform_sql
from ..functions.sql_functions import register_scalars, register_scores
from ..sources.tables import table, to_long
from .base import AUCS, GOLD, ORACLE_SQL, RANKED, SCORED, gold, query, scored

r6 = lambda c: F.round(c, 6)


@query("met1_auc", f"WITH {AUCS} SELECT arm, label, n_pos, n_neg, round(auc, 6) AS auc FROM aucs")
def met1(spark, d):
    return auc(scored(spark, d), ["arm", "label"], parts=64).select("arm", "label", "n_pos", "n_neg", r6("auc").alias("auc"))


@query(
    "met2_balanced_accuracy",
    f"""WITH {SCORED} SELECT arm, label, round((avg(CASE WHEN y = 1 THEN CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END END::DOUBLE)
    + avg(CASE WHEN y = 0 THEN CASE WHEN p < 0.5 THEN 1.0 ELSE 0.0 END END::DOUBLE)) / 2, 6) AS bal_acc FROM scored GROUP BY arm, label""",
)
def met2(spark, d):
    return scored(spark, d).groupBy("arm", "label").agg(r6(balanced_accuracy(F.col("y"), F.col("p"))).alias("bal_acc"))


@query("met3_macro_auc", f"WITH {AUCS} SELECT arm, round(avg(auc), 6) AS macro_auc, count(auc) AS n_labels FROM aucs GROUP BY arm")
def met3(spark, d):
    return macro(auc(scored(spark, d), ["arm", "label"]), ["arm"]).withColumn("macro_auc", r6("macro_auc"))


HANLEY = """sqrt(greatest(0.0, (auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc)
    + (n_neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n_pos * n_neg)))"""


@query(
    "met4_hanley_se",
    f"""WITH {AUCS}, se AS (SELECT *, {HANLEY} AS se FROM aucs)
SELECT arm, round(avg(auc), 6) AS macro_auc, round(sqrt(sum(se * se)) / count(*), 6) AS macro_se, round(max(se), 6) AS max_se FROM se GROUP BY arm""",
)
def met4(spark, d):
    a = auc(scored(spark, d), ["arm", "label"]).withColumn("se", hanley_se(F.col("auc"), F.col("n_pos"), F.col("n_neg")))
    return a.groupBy("arm").agg(r6(F.avg("auc")).alias("macro_auc"), r6(F.sqrt(F.sum(F.col("se") * F.col("se"))) / F.count("*")).alias("macro_se"), r6(F.max("se")).alias("max_se"))


@query(
    "met5_wilson",
    f"""WITH {GOLD}, c AS (SELECT lang, label, sum(y)::DOUBLE AS k, count(*)::DOUBLE AS n FROM gold GROUP BY ALL)
SELECT lang, label, round(greatest(0.0, ((k / n + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS low,
    round(least(1.0, ((k / n + 1.96 * 1.96 / (2 * n)) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS high FROM c""",
)
def met5(spark, d):
    c = gold(spark, d).groupBy("lang", "label").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return c.select("lang", "label", r6(low).alias("low"), r6(high).alias("high"))


#: Replicates of a bootstrap.
REPLICATES = 1000


def weights_sql(reps: int, docs: str = "SELECT DISTINCT doc_id FROM scored") -> str:
    return f"""weights AS (SELECT doc_id, rep, {CUTS_SQL} AS w FROM (SELECT doc_id, rep, {uniform_sql('doc_id', 'rep')} AS u FROM ({docs}), range({reps}) t(rep)))"""


def boot_sql(reps: int = REPLICATES) -> str:
    return f"""{SCORED}, {weights_sql(reps)},
cells AS (
    SELECT arm, label, rep, p, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM scored JOIN weights USING (doc_id) WHERE w > 0 GROUP BY ALL),
steps AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY arm, label, rep ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM cells),
boot AS (
    SELECT arm, label, rep, sum(pos * (neg_below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM steps GROUP BY ALL),
macros AS (SELECT arm, rep, avg(auc) AS macro_auc FROM boot GROUP BY ALL)"""


@query("met6_bootstrap_macro", f"WITH {boot_sql()} SELECT arm, round(avg(macro_auc), 5) AS mean, round(stddev_pop(macro_auc), 5) AS sd, round(quantile_cont(macro_auc, 0.025), 5) AS low, round(quantile_cont(macro_auc, 0.975), 5) AS high FROM macros GROUP BY arm")
def met6(spark, d):
    m = macro(bootstrap(scored(spark, d), ["arm", "label"], "doc_id", REPLICATES), ["arm", "rep"])
    q = F.percentile("macro_auc", F.array(F.lit(0.025), F.lit(0.975)))
    r = lambda c: F.round(c, 5)
    return m.groupBy("arm").agg(r(F.avg("macro_auc")).alias("mean"), r(F.stddev_pop("macro_auc")).alias("sd"), r(q[0]).alias("low"), r(q[1]).alias("high"))


@query(
    "met7_paired_bootstrap",
    f"""WITH {boot_sql()}, pairs AS (SELECT a.rep, b.macro_auc - a.macro_auc AS delta FROM macros a JOIN macros b ON a.rep = b.rep AND a.arm = 'a' AND b.arm = 'c')
SELECT round(avg(delta), 5) AS delta, round(stddev_pop(delta), 5) AS sd, round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 5) AS p_better FROM pairs""",
)
def met7(spark, d):
    rows = scored(spark, d).filter(F.col("arm").isin("a", "c"))
    m = macro(bootstrap(rows, ["arm", "label"], "doc_id", REPLICATES), ["arm", "rep"]).groupBy("rep").pivot("arm", ["a", "c"]).agg(F.first("macro_auc"))
    delta = F.col("c") - F.col("a")
    return m.agg(F.round(F.avg(delta), 5).alias("delta"), F.round(F.stddev_pop(delta), 5).alias("sd"), F.round(F.avg((delta > 0).cast("double")), 5).alias("p_better"))


@query(
    "met8_unpaired_sd",
    f"""WITH {boot_sql()}, sds AS (SELECT stddev_pop(macro_auc) FILTER (arm = 'a') AS a, stddev_pop(macro_auc) FILTER (arm = 'c') AS c FROM macros)
SELECT round(sqrt(a * a + c * c), 5) AS unpaired_sd FROM sds""",
)
def met8(spark, d):
    m = macro(bootstrap(scored(spark, d).filter("arm <> 'b'"), ["arm", "label"], "doc_id", REPLICATES), ["arm", "rep"])
    sd = lambda arm: F.stddev_pop(F.when(F.col("arm") == arm, F.col("macro_auc")))
    return m.agg(F.round(F.hypot(sd("a"), sd("c")), 5).alias("unpaired_sd"))


@query(
    "met9_subgroup_gap",
    f"""WITH {SCORED}, top AS (SELECT lang, row_number() OVER (ORDER BY n DESC, lang) AS g FROM (SELECT lang, count(DISTINCT doc_id) AS n FROM gold GROUP BY lang) QUALIFY g <= 2),
part AS (SELECT scored.*, g FROM scored JOIN top USING (lang) WHERE arm = 'c'),
r AS (SELECT *, rank() OVER (PARTITION BY g, label ORDER BY p) + (count(*) OVER (PARTITION BY g, label, p) - 1) / 2.0::DOUBLE AS ar FROM part),
a AS (SELECT g, label, count(*) AS n, sum(y)::BIGINT AS n_pos, (sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE AS auc FROM r GROUP BY ALL),
{weights_sql(REPLICATES)},
cells AS (SELECT g, label, rep, p, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM part JOIN weights USING (doc_id) WHERE w > 0 GROUP BY ALL),
steps AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY g, label, rep ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM cells),
boot AS (SELECT g, label, rep, sum(pos * (neg_below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM steps GROUP BY ALL),
gaps AS (SELECT label, avg(gap) AS mean, stddev_pop(gap) AS sd FROM (SELECT x.label, x.auc - z.auc AS gap FROM boot x JOIN boot z ON x.label = z.label AND x.rep = z.rep AND x.g = 1 AND z.g = 2) GROUP BY label)
SELECT x.label, x.n AS n_1, z.n AS n_2, x.n_pos AS n_pos_1, z.n_pos AS n_pos_2, round(x.auc - z.auc, 6) AS gap, round(mean, 5) AS boot_gap, round(sd, 5) AS boot_sd,
    round(abs(x.auc - z.auc) / nullif(sd, 0), 3) AS sigma FROM a x JOIN a z ON x.label = z.label AND x.g = 1 AND z.g = 2 LEFT JOIN gaps ON gaps.label = x.label""",
)
def met9(spark, d):
    """The gap between the two largest groups, with its deviation over entities resampled within each group."""
    rows = scored(spark, d).filter("arm = 'c'")
    sizes = rows.groupBy("lang").agg(F.countDistinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(2)
    top = sizes.withColumn("g", F.row_number().over(Window.orderBy(F.desc("n"), "lang"))).select("lang", "g")  # two rows
    rows = rows.join(F.broadcast(top), "lang")
    a = auc(rows, ["g", "label"])
    pick = lambda g, c: F.max(F.when(F.col("g") == g, F.col(c)))
    n = lambda g: F.max(F.when(F.col("g") == g, F.col("n_pos") + F.col("n_neg")))
    gap = pick(1, "auc") - pick(2, "auc")
    out = a.groupBy("label").agg(n(1).alias("n_1"), n(2).alias("n_2"), pick(1, "n_pos").alias("n_pos_1"), pick(2, "n_pos").alias("n_pos_2"), gap.alias("_gap"))
    boot = bootstrap(rows, ["g", "label"], "doc_id", REPLICATES).groupBy("label", "rep").agg(gap.alias("g")).groupBy("label").agg(F.avg("g").alias("mean"), F.stddev_pop("g").alias("sd"))
    out = out.join(boot, "label", "left")
    sigma = F.try_divide(F.abs("_gap"), F.nullif("sd", F.lit(0.0)))
    return out.select("label", "n_1", "n_2", "n_pos_1", "n_pos_2", r6("_gap").alias("gap"), F.round("mean", 5).alias("boot_gap"), F.round("sd", 5).alias("boot_sd"), F.round(sigma, 3).alias("sigma"))


@query(
    "met10_gap_difference",
    f"""WITH {SCORED}, part AS (SELECT *, lang = 'en' AS g FROM scored),
r AS (SELECT *, rank() OVER (PARTITION BY arm, g, label ORDER BY p) + (count(*) OVER (PARTITION BY arm, g, label, p) - 1) / 2.0::DOUBLE AS ar FROM part),
a AS (SELECT arm, g, label, (sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE AS auc FROM r GROUP BY ALL),
gaps AS (SELECT arm, label, max(auc) FILTER (g) - max(auc) FILTER (NOT g) AS gap FROM a GROUP BY ALL)
SELECT arm, round(avg(gap) FILTER (label = 'toxic') - avg(gap) FILTER (label = 'quality'), 6) AS difference FROM gaps GROUP BY arm""",
)
def met10(spark, d):
    a = auc(scored(spark, d).withColumn("g", F.col("lang") == "en"), ["arm", "g", "label"])
    gaps = a.groupBy("arm", "label").agg((F.max(F.when(F.col("g"), F.col("auc"))) - F.max(F.when(~F.col("g"), F.col("auc")))).alias("gap"))
    side = lambda x: F.avg(F.when(F.col("label") == x, F.col("gap")))
    return gaps.groupBy("arm").agg(r6(side("toxic") - side("quality")).alias("difference"))


@query(
    "met11_spearman",
    f"""WITH {RANKED}, w AS (SELECT label, doc_id, max(avg_rank) FILTER (arm = 'a') AS a, max(avg_rank) FILTER (arm = 'b') AS b, max(avg_rank) FILTER (arm = 'c') AS c FROM ranked GROUP BY ALL)
SELECT label, round(corr(a, b), 6) AS ab, round(corr(a, c), 6) AS ac, round(corr(b, c), 6) AS bc FROM w GROUP BY label""",
)
def met11(spark, d):
    w = ranked(scored(spark, d), ["arm", "label"], "p").groupBy("label", "doc_id").pivot("arm", ["a", "b", "c"]).agg(F.first("avg_rank"))
    return w.groupBy("label").agg(*[r6(corr(x, y)).alias(x + y) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])


@query(
    "met12_mean_abs_correlation",
    f"""WITH {SCORED}, c AS (SELECT x.arm AS arm_1, z.arm AS arm_2, x.label, corr(x.p, z.p) AS r FROM scored x JOIN scored z ON x.doc_id = z.doc_id AND x.label = z.label AND x.arm < z.arm GROUP BY ALL)
SELECT arm_1, arm_2, round(avg(abs(r)), 6) AS mean_abs_r FROM c GROUP BY ALL""",
)
def met12(spark, d):
    w = scored(spark, d).groupBy("label", "doc_id").pivot("arm", ["a", "b", "c"]).agg(F.first("p"))
    pairs = F.array(*[F.struct(F.lit(x).alias("arm_1"), F.lit(y).alias("arm_2"), corr(x, y).alias("r")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])
    return w.groupBy("label").agg(pairs.alias("x")).select(F.inline("x")).groupBy("arm_1", "arm_2").agg(r6(F.avg(F.abs("r"))).alias("mean_abs_r"))


@query("met13_offset", f"WITH {AUCS}, m AS (SELECT arm, avg(auc) AS macro_auc FROM aucs GROUP BY arm) SELECT arm, round(macro_auc + 0.02, 6) AS expected, round(0.9 - macro_auc, 6) AS implied_offset FROM m")
def met13(spark, d):
    m = macro(auc(scored(spark, d), ["arm", "label"]), ["arm"])
    return m.select("arm", r6(F.col("macro_auc") + 0.02).alias("expected"), r6(0.9 - F.col("macro_auc")).alias("implied_offset"))


@query(
    "met14_source_ladder",
    f"""WITH {AUCS}, best AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY auc DESC) AS place FROM aucs)
SELECT arm, round(avg(auc), 6) AS macro_auc, count(*) FILTER (place = 1) AS wins, rank() OVER (ORDER BY avg(auc) DESC) AS ladder FROM best GROUP BY arm""",
)
def met14(spark, d):
    a = auc(scored(spark, d), ["arm", "label"]).withColumn("place", F.rank().over(Window.partitionBy("label").orderBy(F.desc("auc"))))  # a row a source
    m = a.groupBy("arm").agg(F.avg("auc").alias("m"), F.count_if(F.col("place") == 1).alias("wins"))
    return m.select("arm", r6("m").alias("macro_auc"), "wins", F.rank().over(Window.orderBy(F.desc("m"))).cast("long").alias("ladder"))


@query(
    "met15_loo_logloss",
    f"""WITH {GOLD}, c AS (SELECT lang, label, sum(y)::DOUBLE AS k, count(*)::DOUBLE AS n FROM gold GROUP BY ALL), t AS (SELECT label, sum(k) AS pk, sum(n) AS pn FROM c GROUP BY label),
l AS (SELECT c.*, least(1 - 1e-6, greatest(1e-6, (k - 1 + 5 * (pk - 1) / (pn - 1)) / (n - 1 + 5))) AS p1, least(1 - 1e-6, greatest(1e-6, (k + 5 * pk / (pn - 1)) / (n - 1 + 5))) AS p0 FROM c JOIN t USING (label))
SELECT label, round(sum(-k * ln(p1) - (n - k) * ln(1 - p0)) / sum(n), 6) AS loo FROM l GROUP BY label""",
)
def met15(spark, d):
    return loo_logloss(gold(spark, d), ["lang"], F.lit(5.0)).groupBy("label").agg(r6(F.sum("loss") / F.sum("n")).alias("loo"))


def loo_logloss(rows, cells, m):
    """Leave-one-out log loss of shrunk cell rates: closed form, k rows of label 1 and n - k of label 0 a cell; the prior leaves the row out too."""
    c = rows.groupBy("label", *cells).agg(F.sum("y").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    t = c.groupBy("label").agg(F.sum("k").alias("pk"), F.sum("n").alias("pn"))
    clip = lambda x: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), x))
    k, n, pk, pn = (F.col(x) for x in ("k", "n", "pk", "pn"))
    p1, p0 = clip((k - 1 + m * (pk - 1) / (pn - 1)) / (n - 1 + m)), clip((k + m * pk / (pn - 1)) / (n - 1 + m))
    return c.join(F.broadcast(t), "label").withColumn("loss", -k * F.log(p1) - (n - k) * F.log(1 - p0))


@query(
    "met16_chi_square",
    """WITH c AS (SELECT doc_id % 5 AS fold, count(*)::DOUBLE AS o FROM labels GROUP BY 1), e AS (SELECT avg(o) AS e FROM c) SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2, count(*) AS folds FROM c, e""",
)
def met16(spark, d):
    c = table(spark, d, "labels").groupBy(F.pmod("doc_id", F.lit(5)).alias("fold")).agg(F.count("*").alias("o"))
    return c.agg(r6(F.sum(F.col("o") * F.col("o")) / F.avg("o") - F.sum("o")).alias("chi2"), F.count("*").alias("folds"))


WIDE = """wide AS (SELECT label, doc_id, y, max(p) FILTER (arm = 'a') AS a, max(p) FILTER (arm = 'b') AS b, max(p) FILTER (arm = 'c') AS c FROM scored GROUP BY ALL)"""


def wide(spark, d):
    return scored(spark, d).groupBy("label", "doc_id", "y").pivot("arm", ["a", "b", "c"]).agg(F.first("p"))


@query(
    "met17_prediction_delta",
    f"WITH {SCORED}, {WIDE} SELECT label, round(avg(abs(a - b)), 6) AS mean_delta, round(corr(a - b, a - c), 6) AS delta_corr, round(avg(abs(a - b)) / avg(abs(a - c)), 6) AS ratio FROM wide GROUP BY label",
)
def met17(spark, d):
    ab, ac = F.col("a") - F.col("b"), F.col("a") - F.col("c")
    return wide(spark, d).groupBy("label").agg(r6(F.avg(F.abs(ab))).alias("mean_delta"), r6(corr(ab, ac)).alias("delta_corr"), r6(F.avg(F.abs(ab)) / F.avg(F.abs(ac))).alias("ratio"))


@query(
    "met18_member_spread",
    f"WITH {SCORED}, {WIDE} SELECT label, round(avg(c - a), 6) AS mean, round(stddev_samp(c - a) / sqrt(count(*)), 6) AS se, count(*) FILTER (c > a) AS n_up, count(*) AS n FROM wide GROUP BY label",
)
def met18(spark, d):
    x = F.col("c") - F.col("a")
    return wide(spark, d).groupBy("label").agg(r6(F.avg(x)).alias("mean"), r6(F.stddev_samp(x) / F.sqrt(F.count("*"))).alias("se"), F.count_if(x > 0).alias("n_up"), F.count("*").alias("n"))


@query(
    "met19_leave_one_out",
    f"""WITH {SCORED}, {WIDE}, conf AS (SELECT label, doc_id, y, unnest(['full', 'no_a', 'no_b', 'no_c']) AS config, unnest([(a + b + c) / 3, (b + c) / 2, (a + c) / 2, (a + b) / 2]) AS p, (a + b + c) / 3 AS base FROM wide),
r AS (SELECT *, rank() OVER (PARTITION BY config, label ORDER BY round(p, 9)) + (count(*) OVER (PARTITION BY config, label, round(p, 9)) - 1) / 2.0::DOUBLE AS ar FROM conf),
a AS (SELECT config, label, (sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE AS auc, sum(abs(p - base)) AS moved, count(*) AS n FROM r GROUP BY ALL),
m AS (SELECT config, avg(auc) AS macro_auc, sum(moved) / sum(n) AS moved FROM a GROUP BY ALL)
SELECT config, round(macro_auc - (SELECT macro_auc FROM m WHERE config = 'full'), 6) AS delta, round(moved, 6) AS moved FROM m WHERE config <> 'full'""",
)
def met19(spark, d):
    a, b, c = (F.col(x) for x in "abc")
    full = (a + b + c) / 3
    configs = F.array(*[F.struct(F.lit(n).alias("config"), F.round(p, 9).alias("p"), F.abs(p - full).alias("move")) for n, p in (("full", full), ("no_a", (b + c) / 2), ("no_b", (a + c) / 2), ("no_c", (a + b) / 2))])
    rows = wide(spark, d).select("label", "doc_id", "y", F.inline(configs))
    m = macro(auc(rows, ["config", "label"]), ["config"]).join(rows.groupBy("config").agg(F.avg("move").alias("moved")), "config")
    base = m.filter("config = 'full'").select(F.col("macro_auc").alias("base"))  # one row
    return m.filter("config <> 'full'").join(F.broadcast(base)).select("config", r6(F.col("macro_auc") - F.col("base")).alias("delta"), r6("moved").alias("moved"))


@query(
    "met19_most_affected",
    f"""WITH {SCORED}, {WIDE}, conf AS (SELECT label, unnest(['no_a', 'no_b', 'no_c']) AS config, unnest([(b + c) / 2, (a + c) / 2, (a + b) / 2]) AS p, (a + b + c) / 3 AS base FROM wide),
m AS (SELECT config, label, round(avg(abs(p - base)), 6) AS moved FROM conf GROUP BY ALL) SELECT config, row_number() OVER (PARTITION BY config ORDER BY moved DESC, label)::INTEGER AS place, label, moved FROM m QUALIFY place <= 3""",
)
def met19_labels(spark, d):
    """The labels whose scores move most when an arm is left out, three an arm."""
    a, b, c = (F.col(x) for x in "abc")
    configs = F.array(*[F.struct(F.lit(n).alias("config"), p.alias("p")) for n, p in (("no_a", (b + c) / 2), ("no_b", (a + c) / 2), ("no_c", (a + b) / 2))])
    rows = wide(spark, d).select("label", ((a + b + c) / 3).alias("base"), F.inline(configs))
    moved = rows.groupBy("config", "label").agg(r6(F.avg(F.abs(F.col("p") - F.col("base")))).alias("moved"))
    place = F.row_number().over(Window.partitionBy("config").orderBy(F.desc("moved"), "label"))  # a row a label
    return moved.withColumn("place", place).filter("place <= 3").select("config", "place", "label", "moved")


@query(
    "met11_spearman_range",
    f"""WITH {RANKED}, w AS (SELECT label, doc_id, max(avg_rank) FILTER (arm = 'a') AS a, max(avg_rank) FILTER (arm = 'b') AS b, max(avg_rank) FILTER (arm = 'c') AS c FROM ranked GROUP BY ALL),
s AS (SELECT label, coalesce(corr(a, b), 0) AS ab, coalesce(corr(a, c), 0) AS ac, coalesce(corr(b, c), 0) AS bc FROM w GROUP BY label),
l AS (SELECT unnest(['ab', 'ac', 'bc']) AS pair, unnest([ab, ac, bc]) AS r FROM s) SELECT pair, round(avg(r), 6) AS mean, round(min(r), 6) AS least, round(max(r), 6) AS most FROM l GROUP BY pair""",
)
def met11_range(spark, d):
    """Rank correlation of each pair of arms over the labels: mean, least and most; 0 where an arm is constant."""
    w = ranked(scored(spark, d), ["arm", "label"], "p").groupBy("label", "doc_id").pivot("arm", ["a", "b", "c"]).agg(F.first("avg_rank"))
    s = w.groupBy("label").agg(*[F.coalesce(corr(x, y), F.lit(0.0)).alias(x + y) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])
    return s.unpivot(["label"], ["ab", "ac", "bc"], "pair", "r").groupBy("pair").agg(r6(F.avg("r")).alias("mean"), r6(F.min("r")).alias("least"), r6(F.max("r")).alias("most"))


@query(
    "met21_error_budget",
    f"""WITH {SCORED}, e AS (SELECT arm, label, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn FROM scored GROUP BY ALL)
SELECT arm, sum(fp + fn)::BIGINT AS errors, sum(abs(fp - fn))::BIGINT AS recoverable FROM e GROUP BY arm""",
)
def met21(spark, d):
    e = errors(scored(spark, d))
    return e.groupBy("arm").agg(F.sum(F.col("fp") + F.col("fn")).alias("errors"), F.sum(F.abs(F.col("fp") - F.col("fn"))).alias("recoverable"))


def errors(rows, threshold=0.5):
    hit = F.col("p") >= threshold
    return rows.groupBy("arm", "label").agg(
        F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"), F.count_if(~hit & (F.col("y") == 0)).alias("tn")
    )


@query(
    "met22_perturbation",
    f"""WITH {SCORED}, {WIDE} SELECT label, round(avg(abs(a - b)) / (avg(abs(a - c)) + avg(abs(b - c))) * 2, 6) AS ratio, round(corr(a, b), 6) AS r,
    CASE WHEN avg(abs(a - b)) < 0.1 * (avg(abs(a - c)) + avg(abs(b - c))) / 2 THEN 'neutral' WHEN avg(abs(a - b)) < (avg(abs(a - c)) + avg(abs(b - c))) / 2 THEN 'small' ELSE 'large' END AS verdict FROM wide GROUP BY label""",
)
def met22(spark, d):
    delta = lambda x, y: F.avg(F.abs(F.col(x) - F.col(y)))
    ratio = delta("a", "b") / ((delta("a", "c") + delta("b", "c")) / 2)
    return wide(spark, d).groupBy("label").agg(r6(ratio).alias("ratio"), r6(corr("a", "b")).alias("r"), F.when(ratio < 0.1, "neutral").when(ratio < 1, "small").otherwise("large").alias("verdict"))


@query(
    "met23_dice",
    f"""WITH {SCORED}, {WIDE}, q AS (SELECT floor(a * 4)::BIGINT AS x, floor(c * 4)::BIGINT AS z FROM wide), cls AS (SELECT * FROM range(4) t(cls))
SELECT cls, round(2.0 * count(*) FILTER (x = cls AND z = cls) / nullif(count(*) FILTER (x = cls) + count(*) FILTER (z = cls), 0), 6) AS dice, round(avg((x = z)::INTEGER), 6) AS exact FROM q, cls GROUP BY cls""",
)
def met23(spark, d):
    """Overlap by class, and the share of rows on which both agree exactly."""
    q = wide(spark, d).select(F.floor(F.col("a") * 4).alias("x"), F.floor(F.col("c") * 4).alias("z"))
    rows = q.withColumn("cls", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    x, z = F.col("x") == F.col("cls"), F.col("z") == F.col("cls")
    dice = F.try_divide(2.0 * F.count_if(x & z), (F.count_if(x) + F.count_if(z)).cast("double"))
    return rows.groupBy("cls").agg(r6(dice).alias("dice"), r6(F.avg((F.col("x") == F.col("z")).cast("double"))).alias("exact"))


@query("rank1_average_rank", f"WITH {RANKED} SELECT arm, label, doc_id, avg_rank::DOUBLE AS avg_rank FROM ranked")
def rank1(spark, d):
    return ranked(scored(spark, d), ["arm", "label"], "p").select("arm", "label", "doc_id", "avg_rank")


@query("rank2_percent_rank", f"WITH {RANKED} SELECT arm, label, doc_id, round(avg_rank / n, 9) AS pct_rank FROM ranked")
def rank2(spark, d):
    return ranked(scored(spark, d), ["arm", "label"], "p").select("arm", "label", "doc_id", F.round("pct_rank", 9).alias("pct_rank"))


@query(
    "rank3_harmonise",
    f"""WITH {SCORED}, g AS (SELECT source, CASE WHEN count(DISTINCT doc_id) < 20 THEN '__other__' ELSE source END AS grp FROM gold GROUP BY source), s AS (SELECT scored.*, grp FROM scored JOIN g USING (source) WHERE arm = 'c')
SELECT grp, label, doc_id, round((rank() OVER (PARTITION BY grp, label ORDER BY p) + (count(*) OVER (PARTITION BY grp, label, p) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY grp, label), 9) AS r FROM s""",
)
def rank3(spark, d):
    rows = scored(spark, d).filter("arm = 'c'")
    groups = rows.groupBy("source").agg(F.countDistinct("doc_id").alias("n")).select("source", F.when(F.col("n") < 20, "__other__").otherwise(F.col("source")).alias("grp"))
    return ranked(rows.join(groups, "source"), ["grp", "label"], "p").select("grp", "label", "doc_id", F.round("pct_rank", 9).alias("r"))


@query("udf5_auc_of", f"WITH {AUCS} SELECT arm, label, n_pos, n_neg, round(auc, 6) AS auc FROM aucs")
def udf5_auc(spark, d):
    """Areas by a table function in SQL."""
    register_scores(scored(spark, d))
    return spark.sql(" UNION ALL ".join(f"SELECT '{a}' AS arm, label, n_pos, n_neg, round(auc, 6) AS auc FROM auc_of('{a}')" for a in "abc"))


@query("udf5_ranks_of", f"WITH {RANKED} SELECT DISTINCT label, p, avg_rank, round(avg_rank / n, 9) AS pct FROM ranked WHERE arm = 'b'")
def udf5_ranks(spark, d):
    """Ranks and percent ranks of the different scores by a table function in SQL."""
    register_scores(scored(spark, d))
    return spark.sql("SELECT label, p, avg_rank, round(pct_rank, 9) AS pct FROM ranks_of('b')")


@query("udf5_wilson", ORACLE_SQL["met5_wilson"])
def udf5_wilson(spark, d):
    """Intervals by a scalar function in SQL."""
    register_scalars(spark)
    gold(spark, d).createOrReplaceTempView("gold_labels")
    return spark.sql("SELECT lang, label, round(w.low, 6) AS low, round(w.high, 6) AS high FROM (SELECT lang, label, wilson(CAST(sum(y) AS DOUBLE), CAST(count(*) AS DOUBLE)) AS w FROM gold_labels GROUP BY lang, label)")
