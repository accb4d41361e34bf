"""Near-duplicate documents by DartMinHash signatures.

A document's elements are its distinct runs of five words. Darts are thrown at a plane of weight and rank: each unit of an element's weight
is a strip whose darts arrive along the rank axis as a Poisson process seeded by the element alone, so documents that share an element
share its darts. A dart counts if it lands within the element's weight; it names one of k coordinates; each coordinate keeps the dart of
the lowest rank. About k ln k + 2k darts fill the signature whatever the number of elements, as the rank is cut off at that number over the
total weight (and further out where a coordinate stays empty).

Signatures are joined band by band. Texts that share a band are not paired with each other: each is compared with the band's first text, by
exact resemblance, and links are joined to classes. Bands that then still hold several classes are groups whose texts are compared across these classes,
block by block. A group of many blocks, as boilerplate makes them, is first parted by a second shared band: texts of
resemblance 0.8 share 13 of the 32 bands on average, boilerplate of 0.5 two. Blocks hold signatures alone; texts follow only where signatures of
two classes agree enough, and what is sent out are links that join classes, never all pairs. A pair that meets in several groups is compared in one.

Elements are not weighted here: each distinct run has the weight 1, as resemblance of sets asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, lean, materialize, only_near, partitions, prepare, table
from .repeats import Hashes, U, mix, word_symbols

WIDTH = 5
K, BAND = 128, 4
#: Pairs whose signatures agree less than this much are not verified: over 5 standard errors below 0.8.
ESTIMATE = 0.6
#: Texts that one task compares with each other, or with one other text, at a time.
BLOCK = 512
#: Groups of more than so many blocks are parted by a second band.
LARGE = 32


def elements(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct runs of ``width`` words (one shorter run if there are fewer words, none without words)."""
    words, _ = word_symbols([raw])
    return np.unique(Hashes(words).all(min(width, len(words)))) if len(words) else np.zeros(0, U)


def unit(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def dart_signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = K) -> np.ndarray:
    """A row of k dart names for each set of elements (64-bit hashes); weights are 1 unless given. Sets must not be empty."""
    out = np.zeros((len(sets), k), np.uint32)
    darts = k * (np.log(k) + 2)
    weights = weights or [np.ones(len(s)) for s in sets]
    todo = np.arange(len(sets))
    while len(todo):
        sizes = np.array([len(sets[i]) for i in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        x, w = np.concatenate([sets[i] for i in todo]), np.concatenate([weights[i] for i in todo])
        strips = np.ceil(w).astype(np.int64)
        strip = np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips)
        x, w, owner = np.repeat(x, strips), np.repeat(w, strips), np.repeat(owner, strips)
        x = mix(x + strip.astype(U) * U(0x9E3779B97F4A7C15))
        limit = (darts / np.array([weights[i].sum() for i in todo]))[owner]
        rank, seed, found = np.zeros(len(x)), x.copy(), []
        while len(x):
            seed = mix(seed + U(0xA0761D6478BD642F))
            rank = rank - np.log(unit(seed))
            on = rank <= limit
            x, w, owner, strip, limit, rank, seed = (a[on] for a in (x, w, owner, strip, limit, rank, seed))
            place = mix(seed ^ U(0xE7037ED1A0B428DB))
            hit = strip + unit(place) < w
            found.append((owner[hit] * k + (seed[hit] % U(k)).astype(np.int64), rank[hit], (place[hit] >> U(20)).astype(np.uint32)))
        cell, rank, name = (np.concatenate(a) for a in zip(*found, strict=True))
        order = np.argsort(rank)[::-1]
        best, filled = np.zeros(len(todo) * k, np.uint32), np.zeros(len(todo) * k, bool)
        best[cell[order]] = name[order]
        filled[cell] = True
        full = filled.reshape(-1, k).all(1)
        out[todo[full]] = best.reshape(-1, k)[full]
        todo, darts = todo[~full], 2 * darts
    return out


def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Signature (16 bits a coordinate) and band hashes of each text that has words."""
    for part in parts:
        part = part.drop_duplicates("_t")
        sets = [elements(r) for r in part["raw"]]
        some = np.array([len(s) > 0 for s in sets], bool)
        if some.any():
            s = dart_signatures([x for x in sets if len(x)])
            b = s.reshape(len(s), -1, BAND).astype(U)
            h = np.zeros(b.shape[:2], U) + np.arange(b.shape[1], dtype=U)
            for i in range(BAND):
                h = mix(h * U(0x9E3779B97F4A7C15) + b[:, :, i])
            yield pd.DataFrame({"_t": part["_t"].to_numpy()[some], "signature": [x.astype("<u2").tobytes() for x in s], "bands": list(h.view(np.int64))})


def alike(least: float):
    """mapInPandas function over rows (_a, _salt, lead, _b, raw), sorted so that each group's lead comes first: the pairs alike enough."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, lead = None, None
        for part in parts:
            out = []
            for a, salt, first, b, raw in zip(part["_a"], part["_salt"], part["lead"], part["_b"], part["raw"], strict=True):
                if first:
                    at, lead = (a, salt), elements(raw)
                elif at == (a, salt):
                    if alike_enough(lead, elements(raw), least):
                        out.append((a, b))
            yield pd.DataFrame(out, columns=["_a", "_b"], dtype=np.int64)

    return run


def alike_enough(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def compare_blocks(least: float, texts: bool):
    """mapInPandas function over rows sorted by (band, i, j): pairs of block i and block j that are of different classes, agree enough by signature and meet here: the
    group's bands are the first ones that the pair shares. Without texts: the rows that have such a pair. With texts: the links, verified exactly, but for
    classes that a link found here has joined, so there are fewer links than rows."""

    def near(held: list) -> Iterator[tuple[int, int]]:
        cls = np.unique([r[1] for r in held], return_inverse=True)[1]
        order = np.lexsort((cls, np.bincount(cls)[cls]))  # the largest class last: its rows are not compared with each other
        s, cls = np.stack([np.frombuffer(held[k][3], "<u2") for k in order]), cls[order]
        side, want = np.array([held[k][2] for k in order]), np.zeros(K // BAND, bool)
        want[held[0][4]] = True
        alone = not side.any()
        left, right = (np.arange(len(order)),) * 2 if alone else (np.flatnonzero(side == k) for k in (0, 1))
        left = left[cls[left] != cls[-1]] if alone else left
        for lo in range(0, len(left), 16):
            a = left[lo : lo + 16]
            b = right[right > a[0]] if alone else right
            ok = ((s[a, None] == s[None, b]).sum(2) >= ESTIMATE * K) & (cls[a, None] != cls[None, b])
            if alone:
                ok &= a[:, None] < b
            i, j = (x[y] for x, y in zip((a, b), np.nonzero(ok), strict=True))
            shared = (s[i] == s[j]).reshape(-1, K // BAND, BAND).all(2)
            first = shared & (np.cumsum(shared, 1) <= want.sum())
            yield from ((int(order[x]), int(order[y])) for x, y, here in zip(i, j, (first == want).all(1), strict=True) if here)

    def links(at: tuple, held: list) -> pd.DataFrame:
        if not texts:
            some = sorted({k for pair in near(held) for k in pair})
            return pd.DataFrame([(*at, *held[k][:3], held[k][4]) for k in some], columns=["band", "i", "j", "_t", "label", "side", "places"])
        t, cls, sets, out = [r[0] for r in held], np.array([r[1] for r in held]), {}, []

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = elements(held[i][5])
            return sets[i]

        for i, k in near(held):
            if cls[i] != cls[k] and alike_enough(set_of(i), set_of(k), least):
                out.append((min(t[i], t[k]), max(t[i], t[k])))
                cls[cls == cls[k]] = cls[i]
        return pd.DataFrame(out, columns=["_a", "_b"], dtype=np.int64)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for part in parts:
            for band, i, j, *row in part[["band", "i", "j", "_t", "label", "side", "signature", "places"] + ["raw"] * texts].itertuples(index=False, name=None):
                if (band, i, j) != at:
                    if len(held) > 1:
                        yield links(at, held)
                    at, held = (band, i, j), []
                held.append(row)
        if len(held) > 1:
            yield links(at, held)

    return run


def several_classes(groups: DataFrame) -> DataFrame:
    """The rows (band, places, _t, label) of bands with more than one label, and their number in the band as n."""
    some = groups.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("band", "n")
    return materialize(groups.join(materialize(some, narrow=True), "band"), narrow=True)


def parted(groups: DataFrame, banded: DataFrame, most: int) -> DataFrame:
    """Groups of more than ``most`` rows parted by a second band that rows share."""
    small = groups.filter(F.col("n") <= most)
    big = groups.filter(F.col("n") > most)
    if big.limit(1).count():
        finer = big.join(banded.withColumnsRenamed({"band": "more", "place": "at"}), "_t").filter(F.col("at") > F.element_at("places", -1))
        finer = finer.select(F.xxhash64("band", "more").alias("band"), F.concat("places", F.array("at")).alias("places"), "_t", "label")
        small = small.unionByName(several_classes(finer))
    return small


def components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """_t and label, the least node of its component, for each node of the edges (_a, _b).

    Each round every node takes the least of itself and its neighbours as its label, and the graph is contracted to the labels that still
    have an edge between them; the rounds' labels are then put together. An error is raised if edges are left after most_rounds.
    """
    levels = []
    e = edges.select("_a", "_b").filter("_a <> _b")
    for _ in range(most_rounds):
        both = e.select(F.col("_a").alias("_t"), F.col("_b").alias("n")).unionByName(e.select(F.col("_b").alias("_t"), F.col("_a").alias("n")))
        label = materialize(both.groupBy("_t").agg(F.min("n").alias("label")).withColumn("label", F.least("_t", "label")), narrow=True)
        levels.append(label)
        a = label.select(F.col("_t").alias("_a"), F.col("label").alias("la"))
        b = label.select(F.col("_t").alias("_b"), F.col("label").alias("lb"))
        e = e.join(a, "_a").join(b, "_b").select(F.least("la", "lb").alias("_a"), F.greatest("la", "lb").alias("_b")).filter("_a <> _b").distinct()
        e = materialize(e, narrow=True)
        if e.limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    out = levels[0]
    for label in levels[1:]:
        nxt = label.select(F.col("_t").alias("label"), F.col("label").alias("_next"))
        out = out.join(nxt, "label", "left").select("_t", F.coalesce("_next", "label").alias("label"))
    return materialize(out, narrow=True) if len(levels) > 1 else out


def texts_of(rows: DataFrame, firsts: DataFrame, nodes: DataFrame) -> DataFrame:
    """_t, raw of the nodes, each once."""
    wanted = materialize(firsts.join(nodes, "_t").select("_t", "_d"), narrow=True)
    return only_near(rows, wanted, "_t", "_d").join(wanted, ["_t", "_d"]).select("_t", "raw").dropDuplicates(["_t"])


def verified(rows: DataFrame, firsts: DataFrame, edges: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """The pairs (_a, _b) of edges whose texts resemble each other by ``least`` or more. A text goes once to each text it is compared with; one
    with many partners is copied to several tasks, each with a share of them."""
    spark = rows.sparkSession
    degree = materialize(edges.groupBy("_a").agg((F.floor(F.count("*") / block) + 1).cast("int").alias("salts")), narrow=True)
    salt = F.pmod(F.xxhash64("_b"), F.col("salts")).cast("int").alias("_salt")
    roles = edges.join(degree, "_a").select("_a", salt, F.lit(False).alias("lead"), "_b", F.col("_b").alias("_t"))
    leads = degree.select("_a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"), F.lit(True).alias("lead"), F.col("_a").alias("_b"), F.col("_a").alias("_t"))
    roles = materialize(roles.unionByName(leads), narrow=True)
    texts = texts_of(rows, firsts, roles.select("_t").distinct())
    groups = texts.join(roles, "_t").select("_a", "_salt", "lead", "_b", "raw")
    groups = groups.repartition(partitions(spark), "_a", "_salt").sortWithinPartitions("_a", "_salt", F.desc("lead"))
    return groups.mapInPandas(lean(alike(least)), "_a long, _b long")


def named_texts(rows: DataFrame, name_bits: int) -> tuple[DataFrame, DataFrame]:
    """rows (_m, _d, raw) with _t, a number for each different text, and the texts' table (_m, _t, _d: the least id, copies).

    A text is known by _m, its 128-bit digest; _t is a hash, and texts whose hashes collide (all but never with 64 bits) get another number.
    """
    rows = rows.withColumn("_t", F.xxhash64("raw").bitwiseAND(F.lit((1 << name_bits) - 1 if name_bits < 64 else -1)))
    firsts = materialize(rows.groupBy("_m", "_t").agg(F.min("_d").alias("_d"), F.count("*").alias("copies")), narrow=True)
    twins = firsts.groupBy("_t").agg(F.count("*").alias("n")).filter("n > 1").select("_t")
    other = materialize(firsts.join(twins, "_t", "left_semi").select("_m", F.xxhash64("_m", F.lit(1)).alias("_other")), narrow=True)
    if (n := other.count()) == 0:
        return rows, firsts
    other = F.broadcast(other) if n <= 1_000_000 else other
    anew = lambda df: df.join(other, "_m", "left").withColumn("_t", F.coalesce("_other", "_t")).drop("_other")
    return anew(rows), materialize(anew(firsts), narrow=True)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, block: int = BLOCK, large: int = LARGE, name_bits: int = 64, digests: bool = False) -> DataFrame:
    """One row for each row of docs: id_col, class_id (the least id of its class) and class_size (rows); with ``digests`` also text_md5, of the row's text, and
    class_md5, of the text that stands for the class (that of class_id, the least digest of several).

    Rows of equal texts are one class, and classes are joined by links between texts whose sets of five-word runs
    have a resemblance of ``least`` or more. Null counts as empty; texts without words are alike only if equal; null ids count as the
    smallest number; an empty table gives none; other columns are ignored. Groups of more than ``block`` texts are compared block by block; those of more
    than ``large`` blocks are parted first. Names of texts cut to name_bits collide, which does not change the result (a means of tests).
    """
    spark = docs.sparkSession
    prepare(spark)
    raw = as_bytes(F.col(text_col))
    rows = docs.select(F.unhex(F.md5(raw)).alias("_m"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_d"), raw.alias("raw"))
    rows, firsts = named_texts(rows, name_bits)
    signed = materialize(rows.select("_t", "raw").mapInPandas(lean(sign), "_t long, signature binary, bands array<long>"))
    firsts_of = firsts.select("_t", "_d")
    banded = signed.select("_t", F.posexplode("bands").alias("place", "band")).withColumn("place", F.col("place").cast("short"))
    shared = materialize(banded.groupBy("band").agg(F.min("_t").alias("_a"), F.max("_t").alias("z")).filter("_a < z").select("band", "_a"), narrow=True)
    members = materialize(banded.join(shared, "band").select("band", "place", "_a", "_t").distinct(), narrow=True)
    stars = members.filter("_a <> _t").select("_a", F.col("_t").alias("_b")).distinct()
    links = materialize(verified(rows, firsts_of, stars, least, block))
    labels = components(links)

    # Bands that still hold several classes.
    groups = members.join(labels, "_t", "left").select("band", F.array("place").alias("places"), "_t", F.coalesce("label", "_t").alias("label"))
    groups = several_classes(materialize(groups, narrow=True))
    if groups.limit(1).count():
        groups = parted(groups, banded.distinct(), large * block)
        blocks = (F.floor((F.col("n") - 1) / block) + 1).cast("int")
        nodes = groups.withColumn("own", F.pmod(F.xxhash64("_t", F.lit(3)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
        placed = nodes.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "_t", "label", side, "places")
        known = materialize(signed.join(groups.select("_t").distinct(), "_t").select("_t", "signature").dropDuplicates(["_t"]))
        schema = "band long, i int, j int, _t long, label long, side int, places array<short>"

        def compared(placed: DataFrame, texts: bool, schema: str) -> DataFrame:
            dealt = placed.join(known, "_t").repartition(partitions(spark), "band", "i", "j").sortWithinPartitions("band", "i", "j")
            columns = ["band", "i", "j", "_t", "label", "side", "signature", "places"] + ["raw"] * texts
            return materialize(dealt.select(columns).mapInPandas(lean(compare_blocks(least, texts)), schema))

        near = compared(placed, False, schema)
        if near.limit(1).count():
            near = near.join(texts_of(rows, firsts_of, near.select("_t").distinct()), "_t")
            links = links.unionByName(compared(near, True, "_a long, _b long"))
            labels = components(links)

    classes = firsts.join(labels, "_t", "left").select("_m", "_t", "_d", "copies", F.coalesce("label", "_t").alias("label"))
    classes = materialize(classes, narrow=True)
    named = materialize(classes.groupBy("label").agg(F.min(F.struct("_d", "_m")).alias("first"), F.sum("copies").alias("class_size")), narrow=True)
    classes = materialize(classes.join(named, "label").select("_m", F.col("first._d").alias("class_id"), F.col("first._m").alias("class_md5"), "class_size"), narrow=True)
    out = rows.select("_m", "_d").join(classes, "_m").withColumns({"_d": F.nullif("_d", F.lit(-(2**63))), "class_id": F.nullif("class_id", F.lit(-(2**63)))})
    more = [F.lower(F.hex("_m")).alias("text_md5"), F.lower(F.hex("class_md5")).alias("class_md5")] if digests else []
    return out.select(F.col("_d").alias(id_col), "class_id", "class_size", *more)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
