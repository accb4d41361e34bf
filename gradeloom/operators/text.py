"""Text operators: normalisation, clauses, glossary matching, states and evidence, built from SQL functions alone."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: State ranks and scores; fixed values.
RANK = {"pos": 4, "hedged": 3, "weak": 2, "neg": 1, "absent": 0}
SCORE = {"pos": 0.95, "hedged": 0.65, "weak": 0.45, "neg": 0.03, "absent": 0.08}
CONFIDENCE = {"pos": 1.0, "neg": 0.9, "hedged": 0.6, "weak": 0.5, "absent": 0.25}

Stems = dict[str, list[str]]


def fold_table(last: int = 0x24F) -> tuple[str, str]:
    """Letters from U+00C0 to ``last`` and what each becomes: one lower-case letter without marks, so that lengths stay."""
    pairs = {"ς": "σ", "µ": "μ", "İ": "i", "ı": "i"}
    for code in range(0xC0, last + 1):
        c = chr(code)
        base = unicodedata.normalize("NFKD", c.lower())[:1]
        if c not in pairs and base and base != c and not unicodedata.combining(base):
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


def normalize(text: Column) -> Column:
    """Lower case without marks, one character for one. Letters that change their length in lower case are mapped before."""
    return F.lower(F.translate(text, *fold_table()))


def normalize_hard(text: Column) -> Column:
    """normalize, with sharp s as ss, separators as blanks, no soft hyphens, and single blanks."""
    text = normalize(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("­"), F.lit("")))
    return F.trim(F.regexp_replace(text, r"[\s_\-/\\]+", " "))


def fold(stem: str) -> str:
    """normalize for a word of this program."""
    return stem.translate(str.maketrans(*fold_table())).lower()


#: Where clauses end: full stops, semicolons, line breaks, and dashes or bullets between blanks.
CLAUSE_END = r"[.;\n\r]+|\s[-–—•]\s"


def clauses(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, pos, raw, clause: the text's clauses as they are and normalised, without blank ones. Clauses are normalised inside the parting, once each: conditions on a clause would repeat it otherwise."""
    parts = F.transform(F.split(F.col(text_col), CLAUSE_END), lambda p: F.struct(p.alias("raw"), normalize(p).alias("clause")))
    return docs.select(*keep, F.posexplode(parts).alias("pos", "part")).select(*keep, "pos", "part.raw", "part.clause").filter(F.col("raw").rlike(r"\S"))


def sections(rows: DataFrame, keys: list[str], heading_words: int = 14) -> DataFrame:
    """rows (of clauses) with heading, whether the clause is one (a few words that end in a colon), and section: the last heading before the clause. A heading ends the section before it, as does a clause without letters."""
    clause = F.trim("clause")
    heading = clause.endswith(":") & (F.size(F.split(clause, r"\s+")) <= heading_words)
    mark = F.when(heading, F.struct(clause.alias("text"))).when(~F.col("clause").rlike(r"\p{L}"), F.struct(F.lit(None).cast("string").alias("text")))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"heading": heading, "section": F.last(mark, ignorenulls=True).over(before)["text"]})


def in_context(weight: Column, penalty: Column, bonus: Column) -> Column:
    """A clause's weight, less where its context speaks against it and more, up to 1, where it speaks for it."""
    weight = F.when(penalty, weight * 0.45).otherwise(weight)
    return F.when(bonus, F.least(F.lit(1.0), weight * 1.35)).otherwise(weight)


def merged_clauses(docs: DataFrame, keys: list[str], text_col: str = "text", heading_words: int = 14, long_words: int = 25) -> DataFrame:
    """keys, pos, part, clause: a heading that ends in a colon is put before the next clause and does not stand alone; a long clause also
    gives its parts between commas that have more than two words."""
    w = Window.partitionBy(*keys).orderBy("pos")
    words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    c = docs.select(*keys, F.posexplode(F.split(F.lower(F.col(text_col)), r"(?<=[.!?])\s+|[;\n\r]+")).alias("pos", "clause"))
    c = c.withColumn("clause", F.trim("clause")).filter("clause <> ''")
    heading = F.col("clause").endswith(":") & (words(F.col("clause")) <= heading_words)
    c = c.withColumns({"head": heading, "before": F.lag(F.when(heading, F.col("clause"))).over(w)}).filter("not head")
    c = c.withColumn("clause", F.concat_ws(" ", "before", "clause")).select(*keys, "pos", "clause")
    parts = F.filter(F.transform(F.split("clause", ","), lambda p: F.trim(p)), lambda p: words(p) > 2)
    extra = F.when(words(F.col("clause")) > long_words, parts).otherwise(F.array().cast("array<string>"))
    return c.select(*keys, "pos", F.posexplode(F.concat(F.array("clause"), extra)).alias("part", "clause"))


def pattern(stems: list[str], word_start: bool) -> str:
    """An alternation of normalised stems. A stem that begins with ^ matches at word starts only, whatever word_start says."""
    starts = r"(?<!\p{L})"
    return "|".join((starts if word_start or s.startswith("^") else "") + re.escape(fold(s.removeprefix("^"))) for s in stems)


def has(clause: Column, lang: Column, stems: Stems, word_start: bool = False) -> Column:
    """Whether the (normalised) clause has a stem of its language: one alternation a language, no join. Cues match at word starts, findings anywhere."""
    out = F.lit(False)
    for code, words in stems.items():
        out = F.when(lang == code, clause.rlike(pattern(words, word_start))).otherwise(out)
    return out


def has_all(clause: Column, term: str) -> Column:
    """A term ``a~b``: every part has to occur."""
    return reduce(lambda a, b: a & b, [clause.contains(p) for p in term.split("~")])


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often use mentions it; inside a function over an array, any other expression is computed anew for each element."""
    return F.transform(F.array(value), use)[0]


#: Elements that gathered() holds before it puts them away: an array is copied whenever something is appended to it.
CHUNK = 64


def gathered(items: Column, start: dict[str, Column], kind: str, step) -> Column:
    """An array from one pass over items. step(state, item) gives the next state, the element for this item, and whether it is kept; start names the state's fields. Elements (of SQL type kind) are appended to short chunks, so that appending copies little."""
    empty = F.struct(*[v.alias(k) for k, v in start.items()], F.array().cast(f"array<array<{kind}>>").alias("_full"), F.array().cast(f"array<{kind}>").alias("_tail"))

    def merge(acc: Column, x: Column) -> Column:
        state, element, kept = step(acc, x)
        put = F.concat(acc["_tail"], F.array(element))
        room = F.size(acc["_tail"]) < CHUNK
        full, tail = F.when(~kept | room, acc["_full"]).otherwise(F.concat(acc["_full"], F.array(acc["_tail"]))), F.when(~kept, acc["_tail"]).when(room, put).otherwise(F.array(element))
        return F.struct(*[v.alias(k) for k, v in state.items()], full.alias("_full"), tail.alias("_tail"))

    return F.aggregate(items, empty, merge, lambda acc: F.flatten(F.concat(acc["_full"], F.array(acc["_tail"]))))


def spans(clause: Column, stems: list[str]) -> Column:
    """All occurrences of the stems as an array of structs (s, e), ascending, also of a stem that overlaps itself. The clause is parted once before every occurrence of a stem, and running sums of the parts' lengths give the places."""

    def of(stem: str) -> Column:
        lengths = F.transform(F.split(clause, f"(?={re.escape(stem)})", -1), lambda p: F.length(p))
        starts = gathered(lengths, {"at": F.lit(1)}, "int", lambda acc, n: ({"at": acc["at"] + n}, acc["at"], F.lit(True)))
        first = F.when(F.startswith(clause, F.lit(stem)), 1).otherwise(2)  # the part before the first occurrence is none
        return F.transform(once(starts, lambda x: F.slice(x, first, F.size(x))), lambda i: F.struct(i.alias("s"), (i + len(stem)).alias("e")))

    return F.sort_array(F.concat(*[F.when(clause.contains(stem), of(stem)).otherwise(F.array().cast("array<struct<s:int,e:int>>")) for stem in stems]))


def distance(a: Column, b: Column) -> Column:
    """The least number of characters between a span of a and one of b: 0 if they overlap, null without spans.

    In order of their starts, a span is nearest to that of the other side which reaches furthest among those before it, so one pass over both sides' spans is enough."""
    side = lambda spans_, k: F.transform(spans_, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k")))
    none = F.lit(None).cast("int")

    def merge(acc: Column, x: Column) -> Column:
        gap = F.greatest(F.lit(0), x["s"] - F.when(x["k"] == 0, acc["b"]).otherwise(acc["a"]))
        gap = F.when(F.when(x["k"] == 0, acc["b"]).otherwise(acc["a"]).isNotNull(), gap)
        return F.struct(F.when(x["k"] == 0, F.greatest(acc["a"], x["e"])).otherwise(acc["a"]).alias("a"), F.when(x["k"] == 1, F.greatest(acc["b"], x["e"])).otherwise(acc["b"]).alias("b"), F.least(acc["gap"], gap).alias("gap"))

    start = F.struct(none.alias("a"), none.alias("b"), none.alias("gap"))
    return F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), start, merge, lambda acc: acc["gap"])


def greedy(found: Column) -> Column:
    """Spans from the left, the longer of those that begin together, without overlaps."""
    order = F.sort_array(F.transform(found, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("m"))))

    def step(acc: Column, x: Column):
        kept = x["s"] >= acc["last"]
        return {"last": F.when(kept, -x["m"]).otherwise(acc["last"])}, F.struct(x["s"].alias("s"), (-x["m"]).alias("e")), kept

    return gathered(order, {"last": F.lit(0)}, "struct<s:int,e:int>", step)


def clause_state(negated: Column, uncertain: Column, mild: Column) -> Column:
    return F.when(negated, "neg").when(uncertain | mild, "hedged").otherwise("pos")


def fold_states(found: DataFrame, keys: list[str], state: str = "state", clause: str = "clause", pos: str = "pos", cut: int = 220) -> DataFrame:
    """keys, state, evidence: the state of the highest rank, and the first clause that has it."""
    rank = F.element_at(F.create_map(*[x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))]), F.col(state))
    best = F.max_by(F.struct(F.col(state).alias("state"), F.substring(F.trim(clause), 1, cut).alias("evidence")), F.struct(rank, -F.col(pos)))
    return found.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.state", "b.evidence")


def lookup(values: dict[str, float], key: Column) -> Column:
    """The value of each key; unknown keys raise an error."""
    m = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    return F.when(F.map_contains_key(m, key), F.element_at(m, key)).otherwise(F.raise_error(F.concat(F.lit("unknown state "), F.coalesce(key, F.lit("null")))))


def polarity(uncertain: Column, negative: Column, normal: Column, tear: Column, positive: Column) -> Column:
    """One polarity over pooled languages: uncertain before negative before normality (unless a tear is named) before positive."""
    return F.when(uncertain, "unc").when(negative, "neg").when(normal & ~tear, "neg").when(positive, "pos")


def severity(high: Column, low: Column) -> Column:
    return F.when(high & ~low, 1.0).when(low & ~high, 0.45).otherwise(0.75)


def evidence_score(best: Column, n_pos: Column, n_neg: Column, n_unc: Column) -> tuple[Column, Column]:
    """Score and confidence from the best weight and the numbers of positive, negative and uncertain clauses."""
    any_ = (n_pos + n_unc) > 0
    score = F.when(any_, F.least(F.lit(0.95), 0.50 + 0.42 * best + 0.03 * F.least(n_pos, F.lit(3)))).when(n_neg > 0, F.greatest(F.lit(0.04), 0.20 - 0.04 * n_neg)).otherwise(0.28)
    conf = F.when(any_, F.least(F.lit(1.0), 0.55 + 0.15 * n_pos)).when(n_neg > 0, F.least(F.lit(0.9), 0.45 + 0.12 * n_neg)).otherwise(0.05)
    return score, conf


def stop_word_counts(text: Column, stop_words: dict[str, list[str]]) -> Column:
    """How many stop words of each language the text has, in the languages' order; one pass over the text."""
    every = "|".join(sorted({re.escape(w) for words in stop_words.values() for w in words}))
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b(?:{every})\b"), F.lit(0))
    return F.transform(F.array(found), lambda f: F.array(*[F.size(F.filter(f, lambda w: w.isin(*words))) for words in stop_words.values()]))[0]


def sniff(text: Column, scripts: dict[str, str], stop_words: dict[str, list[str]], least_script: int = 5, least_words: int = 3) -> Column:
    """The first script found more than least_script times, else the language with most stop words (at least least_words; the first of ties)."""
    every = "|".join(sorted({re.escape(w) for words in stop_words.values() for w in words}))
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b(?:{every})\b"), F.lit(0))  # one pass over the text

    def once(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    def number(found: Column, words: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(*words)))

    names = F.array(*map(F.lit, stop_words))
    counts = once(found, lambda f: F.array(*[number(f, words) for words in stop_words.values()]))
    out = once(counts, lambda c: F.when(F.array_max(c) >= least_words, F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))))
    for k in reversed(scripts):
        out = F.when(F.regexp_count(text, F.lit(scripts[k])) > least_script, k).otherwise(out)
    return F.coalesce(out, F.lit("other"))
