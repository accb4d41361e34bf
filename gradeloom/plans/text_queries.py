"""Label extraction from texts with a small glossary whose stems occur in the test corpus."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import text as t
from ..operators.glossary import RULE_SCHEMA, apply_rules, glossary_hits, read_glossary, write_glossary
from ..sources.tables import table
from .base import documents, query
from .metric_queries import r6

#: (kind, key) -> language -> stems
GLOSSARY = {
    ("finding", "anat"): {"en": ["thor", "ere"], "fr": ["eau"], "de": ["ung"], "es": ["ción"]},
    ("finding", "path"): {"en": ["ingt", "ead"], "fr": ["ouv", "oin"], "de": ["ein"], "es": ["ado"]},
    ("finding", "gen"): {"en": ["stion"], "fr": ["tre"], "de": ["keit"]},
    ("cue", "negation"): {"en": ["is", "was"], "fr": ["les"], "de": ["der"], "es": ["de"]},
    ("cue", "uncertainty"): {"en": ["and"], "fr": ["du"], "de": ["mit"], "es": ["por"]},
    ("cue", "minimal"): {"en": ["be"], "fr": ["un"], "de": ["zu"], "es": ["no"]},
}
#: label: anatomy and pathology that have to meet in a clause
SPEC = {"one": ("anat", "path"), "two": ("gen", "path")}
FINDINGS, CUES = (("anat", "path", "gen"), ("negation", "uncertainty", "minimal"))


#: The letters' table in SQL; \\s of the other engine has one blank more.
NORM = "lower(translate({}, '%s', '%s'))" % t.fold_table()
SPACE = r"\t\n\x0b\f\r "


def sql_stem(stem: str, word_start: bool) -> str:
    return (r"(^|[^\p{L}])" if word_start or stem.startswith("^") else "") + re.escape(t.fold(stem.removeprefix("^")))


def sql_has(kind: str, key: str) -> str:
    cases = " ".join(f"WHEN '{lang}' THEN regexp_matches(clause, '{'|'.join(sql_stem(x, kind == 'cue') for x in s)}')" for lang, s in GLOSSARY[kind, key].items())
    return f"CASE lang {cases} ELSE false END AS {key}"


CL = rf"""cl0 AS (SELECT doc_id, lang, string_split_regex(text, '[.;\n\r]+|[{SPACE}][-–—•][{SPACE}]') AS parts FROM documents),
clauses AS (SELECT *, {NORM.format('raw')} AS clause FROM (SELECT doc_id, lang, unnest(range(len(parts)))::INTEGER AS pos, unnest(parts) AS raw FROM cl0) WHERE regexp_matches(raw, '[^{SPACE}]'))"""
MATCH = f"{CL}, hits AS (SELECT *, {', '.join(sql_has(k, n) for k, n in GLOSSARY)} FROM clauses)"
STATE = "CASE WHEN negation THEN 'neg' WHEN uncertainty OR minimal THEN 'hedged' ELSE 'pos' END"
FOUND = (
    MATCH
    + f""", found AS (
    SELECT doc_id, lang, pos, raw, 'one' AS label, {STATE} AS state FROM hits WHERE anat AND path
    UNION ALL SELECT doc_id, lang, pos, raw, 'two', {STATE} FROM hits WHERE gen AND path
    UNION ALL SELECT doc_id, lang, pos, raw, 'one', CASE WHEN negation THEN 'neg' ELSE 'weak' END FROM hits WHERE gen AND NOT anat AND path),
ranked_states AS (SELECT *, CASE state WHEN 'pos' THEN 4 WHEN 'hedged' THEN 3 WHEN 'weak' THEN 2 ELSE 1 END AS rk FROM found),
best AS (SELECT doc_id, lang, label, state, substr(trim(raw), 1, 220) AS evidence FROM ranked_states QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY rk DESC, pos) = 1),
states AS (SELECT d.doc_id, d.lang, l.label, coalesce(b.state, 'absent') AS state, b.evidence FROM documents d CROSS JOIN (SELECT unnest(['one', 'two']) AS label) l LEFT JOIN best b USING (doc_id, label))"""
)


def clauses(spark, d):
    return t.clauses(documents(spark, d), ["doc_id", "lang"])


def matched(spark, d):
    """Clauses with a boolean for each glossary key."""
    c = clauses(spark, d)
    return c.select("*", *[t.has(F.col("clause"), F.col("lang"), s, kind == "cue").alias(key) for (kind, key), s in GLOSSARY.items()])


def found(spark, d):
    """doc_id, lang, pos, raw, label, state of every clause that speaks of a label; a general finding alone is weak."""
    m = matched(spark, d)
    state = t.clause_state(F.col("negation"), F.col("uncertainty"), F.col("minimal"))
    weak = F.when(F.col("negation"), "neg").otherwise("weak")
    rules = [F.when(F.col(a) & F.col(p), F.struct(F.lit(label).alias("label"), state.alias("state"))) for label, (a, p) in SPEC.items()]
    rules.append(F.when(F.col("gen") & ~F.col("anat") & F.col("path"), F.struct(F.lit("one").alias("label"), weak.alias("state"))))
    return m.select("doc_id", "lang", "pos", "raw", F.explode(F.array_compact(F.array(*rules))).alias("r")).select("doc_id", "lang", "pos", "raw", "r.label", "r.state")


def states(spark, d):
    """doc_id, lang, label, state, evidence for every document and label; ``absent`` without a clause."""
    best = t.fold_states(found(spark, d), ["doc_id", "label"], clause="raw")
    cells = table(spark, d, "documents", "doc_id", "lang").withColumn("label", F.explode(F.array(*map(F.lit, SPEC))))
    return cells.join(best, ["doc_id", "label"], "left").withColumn("state", F.coalesce("state", F.lit("absent")))


@query("txt1_normalize", f"SELECT doc_id, sha256(n) AS digest, length(n) = length(text) AS same_length FROM (SELECT doc_id, text, {NORM.format('text')} AS n FROM documents)")
def txt1(spark, d):
    n = t.normalize(F.col("text"))
    return documents(spark, d).select("doc_id", F.sha2(n, 256).alias("digest"), (F.length(n) == F.length("text")).alias("same_length"))


HARD = NORM.format("replace(replace(text, 'ß', 'ss'), chr(173), '')")


@query("txt2_normalize_hard", f"SELECT doc_id, sha256(trim(regexp_replace({HARD}, '[{SPACE}_\\-/\\\\]+', ' ', 'g'))) AS digest FROM documents")
def txt2(spark, d):
    return documents(spark, d).select("doc_id", F.sha2(t.normalize_hard(F.col("text")), 256).alias("digest"))


@query("txt3_clauses", f"WITH {CL} SELECT doc_id, pos, md5(clause) AS clause FROM clauses")
def txt3(spark, d):
    return clauses(spark, d).select("doc_id", "pos", F.md5("clause").alias("clause"))


@query(
    "txt4_merged_clauses",
    rf"""WITH s AS (SELECT doc_id, string_split_regex(regexp_replace(lower(text), '([.!?])[{SPACE}]+', '\1' || chr(1), 'g'), chr(1) || '|[;\n\r]+') AS parts FROM documents),
c0 AS (SELECT * FROM (SELECT doc_id, unnest(range(len(parts)))::INTEGER AS pos, trim(unnest(parts)) AS clause FROM s) WHERE clause <> ''),
c1 AS (SELECT *, ends_with(clause, ':') AND len(string_split_regex(clause, '[{SPACE}]+')) <= 14 AS head FROM c0),
c2 AS (SELECT *, lag(CASE WHEN head THEN clause END) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM c1),
c3 AS (SELECT doc_id, pos, concat_ws(' ', before, clause) AS clause FROM c2 WHERE NOT head),
c4 AS (SELECT doc_id, pos, list_concat([clause], CASE WHEN len(string_split_regex(trim(clause), '[{SPACE}]+')) > 25
    THEN list_filter(list_transform(string_split(clause, ','), lambda p: trim(p)), lambda p: len(string_split_regex(p, '[{SPACE}]+')) > 2) ELSE [] END) AS parts FROM c3)
SELECT doc_id, pos, unnest(range(len(parts)))::INTEGER AS part, md5(unnest(parts)) AS clause FROM c4""",
)
def txt4(spark, d):
    return t.merged_clauses(documents(spark, d), ["doc_id"]).select("doc_id", "pos", "part", F.md5("clause").alias("clause"))


STEMS = ["and", "^and", "ing", "^ing", "ción", "^de", "ß"]


@query("txt5_stem_search", f"WITH n AS (SELECT lang, {NORM.format('text')} AS text FROM documents) " + " UNION ALL ".join(f"SELECT lang, '{x}' AS stem, count(*) FILTER (regexp_matches(text, '{sql_stem(x, False)}')) AS docs, count(*) FILTER (regexp_matches(text, '{sql_stem(x, True)}')) AS word_start FROM n GROUP BY lang" for x in STEMS))
def txt5(spark, d):
    """Documents by language that hold a stem, anywhere or at a word's start; stems with ^ match there alone."""
    n = documents(spark, d).select("lang", t.normalize(F.col("text")).alias("text"))
    hits = F.array(*[F.struct(F.lit(x).alias("stem"), *[F.col("text").rlike(t.pattern([x], w)).alias(c) for c, w in (("docs", False), ("word_start", True))]) for x in STEMS])
    return n.select("lang", F.explode(hits).alias("h")).groupBy("lang", "h.stem").agg(F.count_if("h.docs").alias("docs"), F.count_if("h.word_start").alias("word_start"))


@query("txt6_glossary_match", f"WITH {MATCH} SELECT lang, {', '.join(f'count(*) FILTER ({k}) AS {k}' for k in FINDINGS)} FROM hits GROUP BY lang")
def txt6(spark, d):
    return matched(spark, d).groupBy("lang").agg(*[F.count_if(F.col(k)).alias(k) for k in FINDINGS])


@query("txt7_conjunction", f"WITH {CL} SELECT doc_id, pos FROM clauses WHERE contains(clause, 'the') AND contains(clause, 'ion')")
def txt7(spark, d):
    return clauses(spark, d).filter(t.has_all(F.col("clause"), "the~ion")).select("doc_id", "pos")


OCC = "list_filter(range(1, greatest(1, length(clause)) + 1), lambda i: substr(clause, i, {n}) = '{s}')"
GAPS = f"list_transform({OCC.format(n=3, s='and')}, lambda a: list_min(list_transform({OCC.format(n=3, s='ion')}, lambda b: greatest(0, greatest(a, b) - least(a + 3, b + 3)))))"


@query("txt8_proximity", f"WITH {CL}, g AS (SELECT doc_id, pos, list_min({GAPS}) AS gap FROM clauses WHERE contains(clause, 'and') AND contains(clause, 'ion')) SELECT doc_id, pos, gap::INTEGER AS gap FROM g WHERE gap <= 25")
def txt8(spark, d):
    c = clauses(spark, d).filter(F.col("clause").contains("and") & F.col("clause").contains("ion"))
    gap = t.distance(t.spans(F.col("clause"), ["and"]), t.spans(F.col("clause"), ["ion"]))
    return c.select("doc_id", "pos", F.explode(F.filter(F.array(gap), lambda g: g <= 25)).alias("gap"))  # computed once; a filter would repeat it


COUNT = "len(regexp_extract_all(clause, '{}'))"


@query("txt9_spans", f"WITH {CL} SELECT doc_id, pos, ({' + '.join(COUNT.format(x) for x in ('and', 'an', 'ion'))})::INTEGER AS hits, {COUNT.format('and|an|ion')}::INTEGER AS kept FROM clauses")
def txt9(spark, d):
    s = t.spans(F.col("clause"), ["and", "an", "ion"])
    sizes = t.once(s, lambda x: F.struct(F.size(x).alias("hits"), F.size(t.greedy(x)).alias("kept")))
    return clauses(spark, d).select("doc_id", "pos", sizes.alias("n")).select("doc_id", "pos", "n.hits", "n.kept")


@query("txt10_cues", f"WITH {MATCH} SELECT lang, {', '.join(f'count(*) FILTER ({k}) AS {k}' for k in CUES)} FROM hits GROUP BY lang")
def txt10(spark, d):
    return matched(spark, d).groupBy("lang").agg(*[F.count_if(F.col(k)).alias(k) for k in CUES])


@query("txt11_clause_states", f"WITH {FOUND} SELECT label, state, count(*) AS n FROM found WHERE state <> 'weak' GROUP BY ALL")
def txt11(spark, d):
    return found(spark, d).filter("state <> 'weak'").groupBy("label", "state").agg(F.count("*").alias("n"))


#: Glossary of the corpus: by language the first letters of its most frequent words of five letters or more, under 24 keys; every fifth at word starts only, every seventh with a word's end as a second part.
STEMS_A_LANGUAGE, KEYS = 150, 24
TERMS = rf"""words AS (SELECT lang, unnest(regexp_extract_all({NORM.format('text')}, '\p{{L}}{{5,}}')) AS word FROM documents WHERE lang IS NOT NULL),
ranked_words AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM words GROUP BY lang, word QUALIFY r <= {STEMS_A_LANGUAGE}),
terms AS (SELECT lang, 'k' || (r % {KEYS}) AS key, substr(word, 1, 4) AS head, CASE WHEN r % 7 = 0 THEN substr(word, length(word) - 2, 3) ELSE '' END AS tail, r % 5 = 0 AS starts FROM ranked_words),
spaced AS (SELECT doc_id, lang, pos, clause, ' ' || regexp_replace(clause, '[^\p{{L}}]', ' ', 'g') AS letters FROM clauses),
keyed AS (SELECT DISTINCT doc_id, spaced.lang, pos, key FROM spaced JOIN terms ON spaced.lang = terms.lang AND contains(letters, CASE WHEN starts THEN ' ' || head ELSE head END) AND contains(clause, tail))"""


def corpus_glossary(spark, d):
    """The glossary, written as JSON of several lines and read back."""
    words = documents(spark, d).filter("lang is not null").select("lang", F.explode(F.regexp_extract_all(t.normalize(F.col("text")), F.lit(r"(\p{L}{5,})"), F.lit(1))).alias("word"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = words.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= STEMS_A_LANGUAGE)
    stem = F.concat(F.when(F.col("r") % 5 == 0, "^").otherwise(""), F.substring("word", 1, 4), F.when(F.col("r") % 7 == 0, F.concat(F.lit("~"), F.substring("word", -3, 3))).otherwise(""))
    rows = top.select(F.lit("findings").alias("kind"), F.concat(F.lit("k"), F.col("r") % KEYS).alias("key"), "lang", stem.alias("stem"))
    return read_glossary(spark, write_glossary(rows))


def keys_hit(spark, d):
    """doc_id, lang, pos, key of every clause and glossary key that it holds."""
    return glossary_hits(clauses(spark, d).select("doc_id", "lang", "pos", "clause"), corpus_glossary(spark, d), ["doc_id", "lang", "pos"])


@query("txt6_glossary_join", f"WITH {CL}, {TERMS} SELECT lang, key, count(*) AS clauses, count(DISTINCT doc_id) AS docs FROM keyed GROUP BY lang, key")
def txt6_join(spark, d):
    """A glossary table of hundreds of stems against all clauses, by an index of rare trigrams."""
    return keys_hit(spark, d).groupBy("lang", "key").agg(F.count("*").alias("clauses"), F.countDistinct("doc_id").alias("docs"))


#: rule, keys it requires, keys it forbids, labels it emits, and the state where nothing qualifies the clause, where it is uncertain, and where it is negated (none: the rule does not apply)
RULES = [
    ("all_three", ["k1"], [], ["a", "b", "c"], "pos", "hedged", None),
    ("unplaced", ["k2"], ["k3", "k4", "k5"], ["a", "b", "c"], "weak", "weak", None),
    ("no_side", ["k6", "k7"], ["k8", "k9"], ["d", "e"], "weak", "weak", "neg"),
]
sql_list = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]::VARCHAR[]"
sql_text = lambda x: "NULL" if x is None else f"'{x}'"
RULES_SQL = "rules(rule, requires, forbids, emits, state, unsure, negated) AS (VALUES " + ", ".join(f"('{r}', {sql_list(a)}, {sql_list(b)}, {sql_list(e)}, {sql_text(p)}, {sql_text(u)}, {sql_text(n)}::VARCHAR)" for r, a, b, e, p, u, n in RULES) + ")"


@query(
    "txt13_ambiguity_rules",
    f"""WITH {MATCH}, {TERMS}, {RULES_SQL}, sets AS (SELECT doc_id, pos, list(key) AS keys FROM keyed GROUP BY ALL),
fired AS (SELECT doc_id, pos, rule, emits, CASE WHEN negation THEN negated WHEN uncertainty THEN unsure ELSE state END AS state FROM sets JOIN hits USING (doc_id, pos), rules WHERE list_has_all(keys, requires) AND NOT list_has_any(keys, forbids))
SELECT doc_id, pos, rule, unnest(emits) AS label, state FROM fired WHERE state IS NOT NULL""",
)
def txt13(spark, d):
    """What a rule table makes of clauses that name a finding without its place: emitted for every label it may be, weak or as told."""
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    cues = matched(spark, d).select("doc_id", "pos", F.col("negation").alias("negated_clause"), F.col("uncertainty").alias("uncertain"))
    sets = keys_hit(spark, d).groupBy("doc_id", "pos").agg(F.collect_set("key").alias("keys")).join(cues, ["doc_id", "pos"])
    return apply_rules(sets, rules, ["doc_id", "pos"])


@query("txt14_fold_states", f"WITH {FOUND} SELECT doc_id, label, state, md5(evidence) AS evidence FROM states")
def txt14(spark, d):
    return states(spark, d).select("doc_id", "label", "state", F.md5("evidence").alias("evidence"))


def sql_map(values: dict) -> str:
    return "CASE state " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + " END"


@query("txt15_state_scores", f"WITH {FOUND} SELECT doc_id, label, {sql_map(t.SCORE)} AS score, {sql_map(t.CONFIDENCE)} AS conf FROM states")
def txt15(spark, d):
    return states(spark, d).select("doc_id", "label", t.lookup(t.SCORE, F.col("state")).alias("score"), t.lookup(t.CONFIDENCE, F.col("state")).alias("conf"))


POL = "CASE WHEN regexp_matches(clause, 'wh') THEN 'unc' WHEN regexp_matches(clause, 'sh') THEN 'neg' WHEN regexp_matches(clause, 'nd') AND NOT regexp_matches(clause, 'ti') THEN 'neg' WHEN regexp_matches(clause, '{}') THEN 'pos' END"
SEV = "CASE WHEN contains(clause, 'ing') AND NOT contains(clause, 'ed') THEN 1.0 WHEN contains(clause, 'ed') AND NOT contains(clause, 'ing') THEN 0.45 ELSE 0.75 END::DOUBLE"
#: of two labels: the finding, a decoy that rules a clause out, and contexts that lower and raise a clause's weight
EVIDENCE = {"main": ("er", "ough|onn", "ter|ent", "ion|eau"), "donor": ("an", "ith", "eit", "ung")}


def polar(spark, d, label: str = "main"):
    """Clauses with polarity and weight."""
    found, decoy, against, favour = EVIDENCE[label]
    c = F.col("clause")
    pol = t.polarity(c.rlike("wh"), c.rlike("sh"), c.rlike("nd"), c.rlike("ti"), c.rlike(found))
    rows = t.sections(clauses(spark, d), ["doc_id"])
    around = lambda p: c.rlike(p) | F.coalesce(F.col("section").rlike(p), F.lit(False))
    sev = t.severity(c.contains("ing"), c.contains("ed"))
    return rows.select("doc_id", "lang", "pos", "clause", pol.alias("pol"), sev.alias("sev"), c.rlike(decoy).alias("decoy"), t.in_context(sev, around(against), around(favour)).alias("weight"))


@query("txt16_polarity", f"WITH {CL} SELECT {POL.format('er')} AS pol, count(*) AS n FROM clauses GROUP BY 1")
def txt16(spark, d):
    return polar(spark, d).groupBy("pol").agg(F.count("*").alias("n"))


@query("txt18_severity", f"WITH {CL} SELECT {SEV} AS sev, count(*) AS n FROM clauses GROUP BY 1")
def txt18(spark, d):
    return polar(spark, d).groupBy("sev").agg(F.count("*").alias("n"))


MARKED = rf"""marked AS (SELECT *, ends_with(trim(clause), ':') AND len(string_split_regex(trim(clause), '[{SPACE}]+')) <= 14 AS heading, NOT regexp_matches(clause, '\p{{L}}') AS bare FROM clauses),
parts AS (SELECT *, coalesce(sum((heading OR bare)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM marked),
heads AS (SELECT doc_id, part + 1 AS part, trim(clause) AS section FROM parts WHERE heading),
placed AS (SELECT parts.*, section FROM parts LEFT JOIN heads USING (doc_id, part))"""


def evid_sql(label: str, name: str = "ev") -> str:
    found, decoy, against, favour = EVIDENCE[label]
    around = lambda p: f"(regexp_matches(clause, '{p}') OR coalesce(regexp_matches(section, '{p}'), false))"
    return f"""pc_{name} AS (SELECT doc_id, {POL.format(found)} AS pol, {SEV} * CASE WHEN {around(against)} THEN 0.45::DOUBLE ELSE 1 END AS low, {around(favour)} AS up FROM placed WHERE NOT regexp_matches(clause, '{decoy}')),
acc_{name} AS (SELECT doc_id, max(CASE pol WHEN 'pos' THEN CASE WHEN up THEN least(1.0::DOUBLE, low * 1.35::DOUBLE) ELSE low END WHEN 'unc' THEN 0.30 END)::DOUBLE AS best, count(*) FILTER (pol = 'pos') AS n_pos, count(*) FILTER (pol = 'neg') AS n_neg, count(*) FILTER (pol = 'unc') AS n_unc FROM pc_{name} GROUP BY doc_id),
{name} AS (SELECT *, CASE WHEN n_pos + n_unc > 0 THEN least(0.95, 0.50 + 0.42 * best + 0.03 * least(n_pos, 3)) WHEN n_neg > 0 THEN greatest(0.04, 0.20 - 0.04 * n_neg) ELSE 0.28 END AS score,
    CASE WHEN n_pos + n_unc > 0 THEN least(1.0, 0.55 + 0.15 * n_pos) WHEN n_neg > 0 THEN least(0.9, 0.45 + 0.12 * n_neg) ELSE 0.05 END AS conf FROM acc_{name})"""


def evidence(spark, d, label: str = "main"):
    """Score and confidence from all clauses of a document that are no decoys."""
    pol = F.col("pol")
    acc = polar(spark, d, label).filter("not decoy").groupBy("doc_id").agg(
        F.max(F.when(pol == "pos", F.col("weight")).when(pol == "unc", 0.30)).alias("best"), *[F.count_if(pol == p).alias(f"n_{p}") for p in ("pos", "neg", "unc")]
    )
    score, conf = t.evidence_score(F.col("best"), F.col("n_pos"), F.col("n_neg"), F.col("n_unc"))
    return acc.withColumns({"score": score, "conf": conf})


@query("txt19_evidence_score", f"WITH {CL}, {MARKED}, {evid_sql('main')} SELECT doc_id, n_pos, n_neg, n_unc, round(score::DOUBLE, 6) AS score, round(conf::DOUBLE, 6) AS conf FROM ev")
def txt19(spark, d):
    """Evidence with decoys left out and weights by context: the clause's own words and the heading of its section."""
    return evidence(spark, d).select("doc_id", "n_pos", "n_neg", "n_unc", r6("score").alias("score"), r6("conf").alias("conf"))


@query("txt20_back_fill", f"WITH {CL}, {MARKED}, {evid_sql('main')}, {evid_sql('donor', 'other')} SELECT ev.doc_id, round((CASE WHEN ev.n_pos + ev.n_neg = 0 THEN greatest(ev.score, 0.28 + 0.45 * (coalesce(other.score, 0.28) - 0.28)) ELSE ev.score END)::DOUBLE, 6) AS score FROM ev LEFT JOIN other USING (doc_id)")
def txt20(spark, d):
    """A silent label takes part of another label's score."""
    donor = evidence(spark, d, "donor").select("doc_id", F.col("score").alias("given"))
    filled = F.greatest("score", 0.28 + 0.45 * (F.coalesce("given", F.lit(0.28)) - 0.28))
    s = F.when(F.col("n_pos") + F.col("n_neg") == 0, filled).otherwise(F.col("score"))
    return evidence(spark, d).join(donor, "doc_id", "left").select("doc_id", r6(s).alias("score"))


@query("txt21_impute_undecided", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN toxic::DOUBLE ELSE quality::DOUBLE END AS v FROM labels")
def txt21(spark, d):
    decided = F.when(F.col("doc_id") % 4 == 0, 0.5).otherwise(F.col("quality").cast("double"))
    return table(spark, d, "labels").select("doc_id", F.when(decided == 0.5, F.col("toxic").cast("double")).otherwise(decided).alias("v"))


STOP = {"en": ["the", "and", "of"], "fr": ["de", "les", "que"], "de": ["der", "und", "die"], "es": ["de", "los", "el"]}
SCRIPTS = {"el": "[α-ω]", "bg": "[а-я]"}
COUNTS = ", ".join(f"len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', '  ', 'g') || ' ', ' ({'|'.join(v)}) ')) AS c_{k}" for k, v in STOP.items())
SNIFF = f"""s AS (SELECT doc_id, lang, {COUNTS} FROM documents), sniffed AS (
    SELECT doc_id, lang, CASE WHEN greatest(c_en, c_fr, c_de, c_es) < 3 THEN 'other' WHEN c_en = greatest(c_en, c_fr, c_de, c_es) THEN 'en' WHEN c_fr = greatest(c_en, c_fr, c_de, c_es) THEN 'fr' WHEN c_de = greatest(c_en, c_fr, c_de, c_es) THEN 'de' ELSE 'es' END AS guess FROM s)"""


@query("txt22_language_sniff", f"WITH {SNIFF} SELECT doc_id, guess FROM sniffed")
def txt22(spark, d):
    return documents(spark, d).select("doc_id", t.sniff(F.col("text"), SCRIPTS, STOP).alias("guess"))


#: Languages of the sniffer that count as one.
MERGE = {"es": "romance", "fr": "romance"}
MERGE_SQL = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MERGE.items()) + f" ELSE {c} END"


@query(
    "txt23_language_disagreement",
    f"""WITH {SNIFF}, c AS (SELECT sniffed.lang, {MERGE_SQL('guess')} AS guess, {MERGE_SQL('sniffed.lang')} AS told, greatest(c_en, c_fr, c_de, c_es) / nullif(c_en + c_fr + c_de + c_es, 0)::DOUBLE AS conf FROM sniffed JOIN s USING (doc_id))
SELECT told, guess, count(*) AS n, count(*) FILTER (guess <> told) AS off, count(*) FILTER (coalesce(conf, 0) < 0.6) AS unsure, round(avg(coalesce(conf, 0)), 6) AS conf FROM c GROUP BY told, guess""",
)
def txt23(spark, d):
    """Told and sniffed languages, some of them merged, with how many guesses are off and how many have less than 0.60 of the stop words found."""
    merge = lambda c: F.coalesce(*[F.when(c == k, v) for k, v in MERGE.items()], c)
    counts = t.stop_word_counts(F.col("text"), STOP)
    g = documents(spark, d).select(merge(F.col("lang")).alias("told"), merge(t.sniff(F.col("text"), SCRIPTS, STOP)).alias("guess"), counts.alias("c"))
    conf = F.coalesce(F.try_divide(F.array_max("c"), F.aggregate("c", F.lit(0), lambda a, x: a + x).cast("double")), F.lit(0.0))
    g = g.withColumn("conf", conf)
    return g.groupBy("told", "guess").agg(F.count("*").alias("n"), F.count_if(F.col("guess") != F.col("told")).alias("off"), F.count_if(F.col("conf") < 0.6).alias("unsure"), r6(F.avg("conf")).alias("conf"))


@query("txt24_silence_rate", f"WITH {FOUND} SELECT lang, label, round(avg(CASE WHEN state = 'absent' THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS silent FROM states GROUP BY ALL")
def txt24(spark, d):
    return states(spark, d).groupBy("lang", "label").agg(r6(F.avg((F.col("state") == "absent").cast("double"))).alias("silent"))


@query("txt25_vocabulary_probe", "SELECT lang, stem, count(*) AS docs FROM documents, (SELECT unnest(['ing', 'eau', 'ung', 'ción']) AS stem) WHERE contains(lower(text), stem) GROUP BY ALL")
def txt25(spark, d):
    probes = F.array(*map(F.lit, ("ing", "eau", "ung", "ción")))
    low = documents(spark, d).select("lang", F.lower("text").alias("low"))
    return low.select("lang", F.explode(F.filter(probes, lambda p: F.contains("low", p))).alias("stem")).groupBy("lang", "stem").agg(F.count("*").alias("docs"))


@query("txt26_qualifier_share", f"WITH {FOUND} SELECT label, count(*) FILTER (regexp_matches(evidence, 'mild|st|sh')) AS qualified, count(evidence) AS n FROM states GROUP BY label")
def txt26(spark, d):
    return states(spark, d).groupBy("label").agg(F.count_if(F.col("evidence").rlike("mild|st|sh")).alias("qualified"), F.count("evidence").alias("n"))


@query("txt27_identical_states", f"WITH {FOUND} SELECT a.lang, round(avg(CASE WHEN a.state = b.state THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS same FROM states a JOIN states b USING (doc_id) WHERE a.label = 'one' AND b.label = 'two' GROUP BY a.lang")
def txt27(spark, d):
    w = states(spark, d).groupBy("doc_id", "lang").pivot("label", list(SPEC)).agg(F.first("state"))
    return w.groupBy("lang").agg(r6(F.avg((F.col("one") == F.col("two")).cast("double"))).alias("same"))


@query("txt28_template_groups", "SELECT count(*) AS groups, max(n) AS largest, sum(n)::BIGINT AS docs FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1)")
def txt28(spark, d):
    g = documents(spark, d).groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n")).filter("n > 1")
    return g.agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.sum("n").alias("docs"))


@query("txt29_contradictions", "SELECT count(*) AS n, count(*) FILTER (regexp_matches(text, 'idiot|scum') <> (toxic = 1)) AS off FROM documents JOIN labels USING (doc_id)")
def txt29(spark, d):
    j = documents(spark, d).join(table(spark, d, "labels"), "doc_id")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike("idiot|scum") != (F.col("toxic") == 1)).alias("off"))


GLOSS_ROWS = [(kind, key, lang, s) for (kind, key), by in GLOSSARY.items() for lang, stems in by.items() for s in stems]


@query("txt30_glossary_gaps", f"WITH g AS (SELECT * FROM (VALUES {', '.join(repr(r) for r in GLOSS_ROWS)}) v(kind, key, lang, stem)) SELECT k.key, l.lang FROM (SELECT DISTINCT key FROM g) k CROSS JOIN (SELECT DISTINCT lang FROM documents) l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.key = k.key AND g.lang = l.lang)")
def txt30(spark, d):
    g = spark.createDataFrame(GLOSS_ROWS, "kind string, key string, lang string, stem string")
    langs = documents(spark, d).agg(F.collect_set("lang").alias("langs"))  # one row; languages are few
    cells = g.select("key").distinct().join(F.broadcast(langs)).select("key", F.explode("langs").alias("lang"))
    return cells.join(g, ["key", "lang"], "left_anti")


#: Stems that a patch adds: some are new, some are there.
PATCH = [("finding", "anat", "en", "bone"), ("finding", "anat", "en", "thor"), ("finding", "gen", "es", "dad"), ("cue", "minimal", "fr", "peu"), ("cue", "minimal", "fr", "un")]


@query("txt30_glossary_patch", f"WITH g AS (SELECT * FROM (VALUES {', '.join(repr(r) for r in GLOSS_ROWS + PATCH)}) v(kind, key, lang, stem)) SELECT g.kind, g.key, g.lang, list_sort(list_distinct(list(g.stem))) AS stems, n FROM g JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang) GROUP BY g.kind, g.key, g.lang, n")
def txt30_patch(spark, d):
    """The glossary with a patch: each cell the sorted, unique union of both; with the number of documents that the cell speaks for."""
    cells = lambda rows: spark.createDataFrame(rows, "kind string, key string, lang string, stem string").groupBy("kind", "key", "lang").agg(F.collect_set("stem").alias("stems"))
    both = cells(GLOSS_ROWS).alias("g").join(cells(PATCH).withColumnRenamed("stems", "more"), ["kind", "key", "lang"], "full")
    none = F.array().cast("array<string>")
    union = F.array_sort(F.array_union(F.coalesce("stems", none), F.coalesce("more", none)))
    return both.select("kind", "key", "lang", union.alias("stems")).join(documents(spark, d).groupBy("lang").agg(F.count("*").alias("n")), "lang")


@query("txt31_preview", r"SELECT doc_id, substr(regexp_replace(trim(text), '\s+', ' ', 'g'), 1, 80) AS preview FROM documents")
def txt31(spark, d):
    return documents(spark, d).select("doc_id", F.substring(F.regexp_replace(F.trim("text"), r"\s+", " "), 1, 80).alias("preview"))


@query("txt32_encoding_damage", "SELECT lang, sum(len(regexp_extract_all(text, '[α-ω]')))::BIGINT AS greek, sum(len(regexp_extract_all(text, '[а-я]')))::BIGINT AS cyrillic, sum(len(regexp_extract_all(text, 'Ã.|â€')))::BIGINT AS mojibake FROM documents GROUP BY lang")
def txt32(spark, d):
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    return documents(spark, d).groupBy("lang").agg(n("[α-ω]").alias("greek"), n("[а-я]").alias("cyrillic"), n("Ã.|â€").alias("mojibake"))


@query("agg10_state_distribution", f"WITH {FOUND} SELECT label, {', '.join(f'''count(*) FILTER (state = '{s}') AS {s}''' for s in t.RANK)} FROM states GROUP BY label")
def agg10(spark, d):
    return states(spark, d).groupBy("label").pivot("state", list(t.RANK)).agg(F.count(F.lit(1))).na.fill(0)


@query("agg11_positive_by_language", f"WITH {FOUND} SELECT lang, round(avg((state = 'pos')::INTEGER) FILTER (label = 'one'), 6) AS one, round(avg((state = 'pos')::INTEGER) FILTER (label = 'two'), 6) AS two FROM states GROUP BY lang")
def agg11(spark, d):
    return states(spark, d).groupBy("lang").pivot("label", list(SPEC)).agg(r6(F.avg((F.col("state") == "pos").cast("double"))))


def sql_gap(a: str, b: str) -> str:
    one = lambda s: OCC.format(n=len(s), s=s)
    return f"list_min(list_transform({one(a)}, lambda a: list_min(list_transform({one(b)}, lambda b: greatest(0, greatest(a, b) - least(a + {len(a)}, b + {len(b)}))))))"


@query("txt12_derived_key", f"WITH {CL}, g AS (SELECT doc_id, pos, {sql_gap('the', 'ing')} AS gap FROM clauses WHERE contains(clause, 'the') AND contains(clause, 'ing')) SELECT doc_id, pos FROM g WHERE gap <= 5")
def txt12(spark, d):
    """A key of its own where a side word stands near a structure."""
    c = clauses(spark, d).filter(F.col("clause").contains("the") & F.col("clause").contains("ing"))
    return c.filter(t.distance(t.spans(F.col("clause"), ["the"]), t.spans(F.col("clause"), ["ing"])) <= 5).select("doc_id", "pos")


@query(
    "txt17_contrary_side",
    f"""WITH {CL}, g AS (SELECT doc_id, pos, contains(clause, 'of the') AS phrase, {sql_gap('ing', 'the')} AS near, {sql_gap('ing', 'and')} AS contrary FROM clauses WHERE contains(clause, 'ing') OR contains(clause, 'of the'))
SELECT doc_id, pos, phrase FROM g WHERE phrase OR (near <= 55 AND near < coalesce(contrary, 1000000))""",
)
def txt17(spark, d):
    """A phrase matches at once; else a stem with its side near it, unless the contrary side is as near."""
    c = F.col("clause")
    rows = clauses(spark, d).filter(c.contains("ing") | c.contains("of the"))
    phrase = c.contains("of the")
    gap = lambda stem, side: t.distance(stem, t.spans(c, [side]))
    near = t.once(t.spans(c, ["ing"]), lambda stem: F.struct(gap(stem, "the").alias("near"), gap(stem, "and").alias("contrary")))
    ahead = F.filter(F.array(near), lambda x: (x["near"] <= 55) & (x["near"] < F.coalesce(x["contrary"], F.lit(1000000))))
    matched_ = F.when(phrase, F.array(F.lit(True))).otherwise(F.transform(ahead, lambda _: F.lit(False)))
    return rows.select("doc_id", "pos", F.explode(matched_).alias("phrase"))
