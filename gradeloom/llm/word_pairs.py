"""Class-conditional Kneser-Ney counts of words, of their beginnings and of pairs of words, as tables that grow with the corpus.

A word is a whole run of letters, marks and digits in any script, lower-cased and not folded otherwise (in scripts written without blanks, a
letter). Expressions form a tree: a word's first letter, its first two letters and so on up to LETTERS of them, the whole word, and the word with
the one before it (a start mark stands before each text). For each class c the probability of going on from an expression e to a longer one x is

    P_c(x | e) = (max(n_c(x) - D, 0) + D * kinds_c(e) * P(x | e)) / n_c(e)

where n_c counts texts, n_c(e) is the sum over what follows e, kinds_c(e) the number of different things that follow it, and P(x | e) is the share by both
classes' counts, to which both classes back off. A step is the log of P_1 / P_0. An expression's log ratio is the sum of the steps to it;
one that no counted text holds is judged by the longest beginning that is known, and such a pair by its word alone.

The steps are rows (key, step). Words' and letters' steps come from joins and groupings; pairs are counted in packed blocks, which need half the
shuffle, and all of them get their steps there. Steps are kept by slices of their keys. A text is scored with the table at hand if it has at most a given number of rows, which are then broadcast; of a larger table,
each slice meets the keys that chunks of texts ask for, packed, and answers with their steps. Both give the same scores.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .repeats import U, mix

ALONE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
WORD = re.compile(f"[{ALONE}]|[^\\s\\x00-/:-@\\[-`{{-\xa1\xab\xb7\xbb\xbf -⁯　-〿＀-／{ALONE}]+")
START = np.int64(1)
LETTERS = 12
DISCOUNT = 0.9
#: Steps are kept as whole numbers of 1 / SCALE.
SCALE = 256
#: Bytes of text of a chunk, and of counted text for each block of pairs.
CHUNK, BLOCK = 8 << 20, 16 << 20
#: Chunks whose keys of a slice meet in one task.
CHUNKS = 256
#: Blocks among which words are dealt; more blocks than these part a word's pairs further, by the word before it.
BY_WORD = 64
#: Words that are held at a time as Python strings.
MANY = 100_000


def words_in(raws: list[bytes]) -> Iterator[tuple[int, list[str]]]:
    """The number of a text and some of its words, in order; a very long text comes in several portions."""
    for i, raw in enumerate(raws):
        text = raw.decode("utf-8", "replace").lower()
        if len(text) <= CHUNK:
            yield i, WORD.findall(text)
            continue
        held = []
        for at in WORD.finditer(text):
            held.append(at.group())
            if len(held) == MANY:
                yield i, held
                held = []
        yield i, held


def word_keys(words: np.ndarray) -> np.ndarray:
    return (mix(pd.util.hash_array(words, categorize=False)) >> U(1)).view(np.int64)


def beginnings(words: np.ndarray) -> np.ndarray:
    """A row of keys for each word: of its first 1 to LETTERS letters (0 beyond its end), and of the whole word."""
    letters = np.array([w[:LETTERS] for w in words], f"U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS).astype(U)
    out, h = np.zeros((len(words), LETTERS + 1), np.int64), np.full(len(words), 7, U)
    for k in range(LETTERS):
        h = mix(h * U(0x9E3779B97F4A7C15) + letters[:, k])
        out[:, k] = np.where(letters[:, k] > 0, (h >> U(1)).view(np.int64), 0)
    out[:, LETTERS] = word_keys(words)
    return out


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (mix(word.view(U) * U(0xC2B2AE3D27D4EB4F) ^ mix(before.view(U) + U(0x165667B19E3779F9))) >> U(1)).view(np.int64)


def before(code: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The word before each one, text by text."""
    h = np.concatenate(([START], code[:-1])) if len(code) else code.copy()
    starts = np.cumsum(counts) - counts
    h[starts[counts > 0]] = START
    return h


def codes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all texts' words, text after text, and each text's number of words."""
    out, held, counts = [np.zeros(0, np.int64)], [], np.zeros(len(raws), np.int64)
    for i, words in words_in(raws):
        counts[i] += len(words)
        held += words
        if len(held) >= MANY:
            out.append(word_keys(np.array(held, object)))
            held = []
    if held:
        out.append(word_keys(np.array(held, object)))
    return np.concatenate(out), counts


# counting


def count_words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """word, n0, n1: in how many of the task's texts of each class a word is."""
    STEPS.clear()  # of a model before this one
    held = [Counter(), Counter()]

    def emit() -> pd.DataFrame:
        words = list(held[0].keys() | held[1].keys())
        return pd.DataFrame({"word": words, "n0": [held[0][w] for w in words], "n1": [held[1][w] for w in words]}).astype({"word": object, "n0": np.int64, "n1": np.int64})

    for part in parts:
        raws, y = part["raw"].tolist(), part["y"].tolist()
        kinds: dict[int, set] = {}
        for i, words in words_in(raws):
            if i in kinds:
                kinds[i].update(words)
            else:
                for k, x in kinds.items():
                    held[y[k]].update(x)
                kinds = {i: set(words)}
        for k, x in kinds.items():
            held[y[k]].update(x)
        if len(held[0]) + len(held[1]) > 300_000:
            yield emit()
            held = [Counter(), Counter()]
    yield emit()


def tree(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, parent, n0, n1 of all beginnings of the words, and of the words themselves, summed within each batch."""
    for part in parts:
        if not len(part):
            continue
        keys = beginnings(part["word"].to_numpy(object))
        parents = np.concatenate([np.zeros((len(part), 1), np.int64), keys[:, :-1]], 1)
        last = (keys[:, :LETTERS] > 0).sum(1)
        parents[:, LETTERS] = np.where(last > 0, keys[np.arange(len(part)), np.maximum(last, 1) - 1], 0)
        out = pd.DataFrame({"key": keys.ravel(), "parent": parents.ravel(), "n0": np.repeat(part["n0"].to_numpy(), LETTERS + 1), "n1": np.repeat(part["n1"].to_numpy(), LETTERS + 1)})
        yield out[out["key"] > 0].groupby(["key", "parent"], as_index=False).sum()


def step_of(n: tuple, total: tuple, kinds: tuple) -> Column:
    """The step from an expression to a longer one; columns of class 0 and 1."""
    share = (n[0] + n[1]) / (total[0] + total[1])
    p = [F.when(t > 0, (F.greatest(x - DISCOUNT, F.lit(0.0)) + DISCOUNT * k * share) / t).otherwise(share) for x, t, k in zip(n, total, kinds, strict=True)]
    return F.round(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.log(p[1] / p[0]))) * SCALE).cast("short")


def planes(x: np.ndarray) -> np.ndarray:
    """Keys as rows of eight bytes, byte place after byte place, so that they compress as far as they can."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def from_planes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(8, -1).T).view("<i8").ravel()


def packed_pairs(w: np.ndarray, h: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs sorted by word: the distinct words, how many pairs each has, the words before, and the counts."""
    words, counts = np.unique(w, return_counts=True)
    parts = [np.array([len(words), len(w)], "<i8"), planes(words), counts.astype("<u4"), planes(h), n[:, 0].astype("<u4"), n[:, 1].astype("<u4")]
    return zlib.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in parts), 1)


def pairs_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    words, pairs = np.frombuffer(data, "<i8", 2).tolist()
    w, at = np.frombuffer(data, np.uint8, 8 * words, 16), 16 + 8 * words
    counts, at = np.frombuffer(data, "<u4", words, at), at + 4 * words
    h, at = np.frombuffer(data, np.uint8, 8 * pairs, at), at + 8 * pairs
    n = np.frombuffer(data, "<u4", 2 * pairs, at).reshape(2, pairs).T.astype(np.int64)
    return np.repeat(from_planes(w), counts), from_planes(h), n


def once_a_text(h: np.ndarray, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once a text, so that one text's repetitions do not outweigh all others."""
    text = np.repeat(np.arange(len(counts)), counts).astype(U)
    _, first = np.unique(pair_keys(h, w).view(U) + text * U(0xA0761D6478BD642F), return_index=True)
    return h[first], w[first]


def summed(w: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, by word, and the sums of n's rows."""
    order = np.lexsort((h, w))
    w, h, n = w[order], h[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])))) if len(w) else np.zeros(0, np.int64)
    return w[first], h[first], np.add.reduceat(n, first) if len(first) else n


def count_pairs(blocks: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def emit() -> pd.DataFrame:
            w, h, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            b, out = w % min(blocks, BY_WORD), []
            if blocks > BY_WORD:
                b = b + h % (blocks // BY_WORD) * BY_WORD
            order = np.argsort(b, kind="stable")
            ends = np.cumsum(np.bincount(b, minlength=blocks))
            for k in np.flatnonzero(np.diff(ends, prepend=0)):
                at = order[(ends[k - 1] if k else 0) : ends[k]]
                out.append((int(k), packed_pairs(w[at], h[at], n[at])))
            return pd.DataFrame(out, columns=["block", "data"])

        for part in parts:
            for y in (0, 1):
                code, counts = codes(part["raw"][part["y"] == y].tolist())
                if len(code):
                    h, code = once_a_text(before(code, counts), code, counts)
                    n = np.zeros((len(code), 2), np.int32)
                    n[:, y] = 1
                    held.append((code, h, n))
                    size += len(code)
            if size > 1_000_000:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    return run


def merge_pairs(part: pd.DataFrame) -> pd.DataFrame:
    """Of a block: a row with all its pairs, packed, and one for each word with its sums and kinds."""
    w, h, n = summed(*(np.concatenate(x) for x in zip(*map(pairs_of, part["data"]), strict=True)))
    block = int(part["block"].iloc[0])
    words, first = np.unique(w, return_index=True)
    total = np.add.reduceat(np.concatenate([n, n > 0], 1), first) if len(first) else np.zeros((0, 4), np.int64)
    sums = pd.DataFrame({"block": block, "word": words, "data": None, **{c: total[:, i] for i, c in enumerate(("t0", "t1", "k0", "k1"))}})
    return pd.concat([pd.DataFrame([(block, 0, packed_pairs(w, h, n), 0, 0, 0, 0)], columns=sums.columns), sums])


def packed_steps(keys: np.ndarray, steps: np.ndarray, slices: int) -> pd.DataFrame:
    """slice, data: steps other than 0 by the first bits of their keys, in order."""
    keys, first = np.unique(keys[steps != 0], return_index=True)
    steps = steps[steps != 0][first]
    part = keys >> np.int64(64 - slices.bit_length())
    ends = np.searchsorted(part, np.arange(slices + 1))
    return pd.DataFrame([(i, slice_bytes(keys[lo:hi], steps[lo:hi])) for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if hi > lo], columns=["slice", "data"])


#: Places of the bytes of a key's distance from the one before it that do not compress.
RAW = 5


def slice_bytes(keys: np.ndarray, steps: np.ndarray) -> bytes:
    """Ascending keys and their steps in some 6 bytes each: distances and steps byte place after byte place, the high ones compressed."""
    gaps, low = planes(np.diff(keys, prepend=np.int64(0))), steps.astype("<i2").view(np.uint8).reshape(-1, 2).T
    return len(keys).to_bytes(8, "little") + gaps[:RAW].tobytes() + zlib.compress(gaps[RAW:].tobytes() + low.tobytes(), 1)


def steps_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw, rest = np.frombuffer(data, np.uint8, RAW * n, 8), np.frombuffer(zlib.decompress(data[8 + RAW * n :]), np.uint8)
    keys = np.cumsum(from_planes(np.concatenate((raw, rest[: (8 - RAW) * n]))))
    return keys, np.ascontiguousarray(rest[(8 - RAW) * n :].reshape(2, -1).T).view("<i2").ravel()


class Slice:
    """A slice of steps for a broadcast: travels packed, and is unpacked where it arrives."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return steps_of, (self.data,)


def pair_steps(slices: int):
    """cogroup function over a block's packed pairs and its words' sums in all blocks: the pairs' steps."""

    def run(pairs: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        w, h, n = pairs_of(pairs["data"].iloc[0])
        totals = totals.sort_values("word")
        at = np.searchsorted(totals["word"].to_numpy(), w)
        t, k = (totals[[f"{c}0", f"{c}1"]].to_numpy(np.float64) for c in "tk")
        share = n.sum(1) / t.sum(1)[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = [np.where(t[at, y] > 0, (np.maximum(n[:, y] - DISCOUNT, 0) + DISCOUNT * k[at, y] * share) / t[at, y], share) for y in (0, 1)]
            x = np.clip(np.log(p[1] / p[0]), -100, 100) * SCALE
        return packed_steps(pair_keys(h, w), (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int16), slices)

    return run


def train_words(rows: DataFrame) -> tuple[DataFrame, int, dict]:
    """From raw and y (0 or 1): the steps by slices of their keys (slice, n, data, and slices, how many there can be), their number, and for (0, class) the numbers of different words, beginnings and pairs."""
    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    blocks = max(16, 1 << int(np.ceil(np.log2(max(1, size / BLOCK)))))
    words = rows.mapInPandas(count_words, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    nodes = materialize(words.mapInPandas(tree, "key long, parent long, n0 long, n1 long").groupBy("key", "parent").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), narrow=True)
    c = F.col
    of_class = lambda *x: (c(x[0]), c(x[1]))
    sums = [F.sum("n0").alias("t0"), F.sum("n1").alias("t1")]
    parents = nodes.groupBy("parent").agg(*sums, F.count_if(c("n0") > 0).alias("k0"), F.count_if(c("n1") > 0).alias("k1"))
    steps = nodes.join(parents, "parent").select("key", step_of(of_class("n0", "n1"), of_class("t0", "t1"), of_class("k0", "k1")).alias("step"))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in gathered(parts):
            yield packed_steps(held["key"].to_numpy(np.int64), held["step"].to_numpy(np.int16), blocks)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        keys, values = (np.concatenate(x) for x in zip(*map(steps_of, part["data"]), strict=True))
        return packed_steps(keys, values, blocks).assign(n=lambda x: [int.from_bytes(d[:8], "little") for d in x["data"]], slices=blocks)

    letters = materialize(steps.mapInPandas(pack, "slice int, data binary"))
    n = nodes.agg(F.count_if(c("n0") > 0).alias("b0"), F.count_if(c("n1") > 0).alias("b1")).first()
    discard(nodes)
    counted = rows.mapInPandas(count_pairs(blocks), "block int, data binary").groupBy("block").applyInPandas(merge_pairs, "block int, word long, data binary, t0 long, t1 long, k0 long, k1 long")
    counted = materialize(counted)
    mine = counted.filter("data is null").withColumnRenamed("block", "place")  # its own name, as it meets the table it comes from again
    totals = mine.groupBy("word").agg(*[F.sum(n).alias(n) for n in ("t0", "t1", "k0", "k1")])
    p = totals.agg(F.count_if(c("t0") > 0).alias("w0"), F.count_if(c("t1") > 0).alias("w1"), F.sum("k0").alias("k0"), F.sum("k1").alias("k1")).first()
    totals = mine.select("place", "word").join(totals, "word") if blocks > BY_WORD else mine.drop("data")
    pairs = counted.filter("data is not null").select("block", "data").groupBy("block").cogroup(totals.groupBy("place")).applyInPandas(pair_steps(blocks), "slice int, data binary")
    pairs = materialize(pairs)
    discard(counted)
    model = materialize(letters.unionByName(pairs).groupBy("slice").applyInPandas(merge, "slice int, data binary, n long, slices int"))
    discard(letters)
    discard(pairs)
    return model, model.agg(F.sum("n")).first()[0] or 0, {(0, y): (p[f"w{y}"], n[f"b{y}"], p[f"k{y}"] or 0) for y in (0, 1)}


def gathered(parts: Iterator[pd.DataFrame], rows: int = 500_000) -> Iterator[pd.DataFrame]:
    """Batches put together to about so many rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= rows:
            yield pd.concat(held)
            held, n = [], 0
    if held:
        yield pd.concat(held)


# scoring


class Steps:
    """A table of steps by key, in slices: each has ascending keys, below those of the next one."""

    def __init__(self, slices: list[tuple[np.ndarray, np.ndarray]]):
        self.slices, self.known = [x for x in slices if len(x[0])], {}

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The steps of ascending keys; 0 for those that are not there."""
        out = np.zeros(len(keys), np.float32)
        if not self.slices:
            return out
        ends = np.searchsorted(keys, [s[0][0] for s in self.slices])
        for (own, steps), lo, hi in zip(self.slices, ends, [*ends[1:], len(keys)], strict=True):
            if hi > lo:
                at = np.minimum(np.searchsorted(own, keys[lo:hi]), len(own) - 1)
                out[lo:hi] = np.where(own[at] == keys[lo:hi], steps[at], 0) / np.float32(SCALE)
        return out

    def of_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and log ratios of different words; a bounded number of them is kept for the next batch."""
        known = self.known
        if new := [w for w in words if w not in known]:
            if len(known) > 150_000:
                known.clear()
                new = list(words)
            for lo in range(0, len(new), MANY):
                part = new[lo : lo + MANY]
                keys = beginnings(np.array(part, object))
                u, at = np.unique(keys, return_inverse=True)
                ratio = self(u)[at].reshape(keys.shape).sum(1)
                known.update(zip(part, zip(keys[:, LETTERS].tolist(), ratio.tolist(), strict=True), strict=True))
        got = [known[w] for w in words]
        return np.array([x for x, _ in got], np.int64), np.array([x for _, x in got], np.float32)


#: One table a Python worker, put in order once and kept from task to task.
STEPS: dict[int, Steps] = {}


def keys_of(raws: list[bytes]) -> np.ndarray:
    """All keys that scoring the texts will ask for."""
    out = [np.zeros(0, np.int64)]
    for _, words in words_in(raws):
        if words:
            out.append(np.unique(beginnings(pd.unique(np.array(words, object)))))
    code, counts = codes(raws)
    out.append(np.unique(pair_keys(before(code, counts), code)))
    keys = np.unique(np.concatenate(out))
    return keys[keys > 0]


#: Log ratios above this are told apart as notable.
NOTABLE = 1.5
TOPS = (1, 2, 4)


def evidence(raws: list[bytes], steps: Steps) -> np.ndarray:
    """Of each text: the mean log ratio a word, the mean of the highest 1, 2 and 4 different words (0 for words that are missing), and the log of the
    mean of what lies above NOTABLE."""
    code, ratio, held, counts = [], [], [], np.zeros(len(raws), np.int64)

    def flush() -> None:
        at, words = pd.factorize(np.array(held, object))
        keys, values = steps.of_words(words)
        code.append(keys[at])
        ratio.append(values[at])
        held.clear()

    for i, words in words_in(raws):
        counts[i] += len(words)
        held += words
        if len(held) >= MANY:
            flush()
    if held:
        flush()
    out = np.zeros((len(raws), 2 + len(TOPS)))
    out[:, -1] = np.log(1e-5)
    if not code:
        return out
    code, ratio = np.concatenate(code), np.concatenate(ratio)
    pairs, at = np.unique(pair_keys(before(code, counts), code), return_inverse=True)
    ratio = ratio + steps(pairs)[at]
    ends = np.cumsum(counts)
    for i in np.flatnonzero(counts):
        v, w = ratio[ends[i] - counts[i] : ends[i]], code[ends[i] - counts[i] : ends[i]]
        out[i, 0], out[i, -1] = v.mean(), np.log(np.maximum(v - NOTABLE, 0).mean() + 1e-5)
        order = np.argsort(-v, kind="stable")
        for few in (64, len(order)):  # most texts need no second look
            _, first = np.unique(w[order[:few]], return_index=True)
            top = v[order[np.sort(first)[: TOPS[-1]]]]
            if len(top) == TOPS[-1]:
                break
        for j, n in enumerate(TOPS):
            out[i, 1 + j] = top[:n].sum() / n
    return out


def broadcast_steps(words: tuple[DataFrame, int, dict], broadcast_rows: int = 24_000_000) -> list | None:
    """The steps (10 bytes each) as one broadcast a slice, for all their readers; None if there are more than broadcast_rows."""
    model, n, _ = words
    if n > broadcast_rows:
        return None
    tables = []
    for r in model.select("slice").orderBy("slice").collect():  # the driver holds a slice at a time
        tables += [model.sparkSession.sparkContext.broadcast(Slice(d)) for d in model.filter(F.col("slice") == r["slice"]).select("data").toArrow()["data"].to_pylist()]
    return tables


def with_words(rows: DataFrame, words: tuple[DataFrame, int, dict], run, schema: str, tables: list | None) -> DataFrame:
    """run(part, evidence) of rows, which have _raw. With tables, from ``broadcast_steps``, rows stay where they are; else slices of
    steps meet the keys that chunks of rows ask for."""
    model = words[0]
    if tables is not None:
        number = tables[0]._jbroadcast.id() if tables else -1

        def score_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if number not in STEPS:
                STEPS.clear()
                STEPS[number] = Steps([t.value for t in tables])
            for part in parts:
                yield run(part, evidence(part["_raw"].tolist(), STEPS[number]))

        return rows.mapInPandas(score_all, schema)

    size, count = rows.agg(F.sum(F.octet_length("_raw")), F.count("*")).first()
    chunks = 1 + (size or 0) // CHUNK + count // 50_000
    parted = rows.withColumn("_chunk", F.pmod(F.xxhash64(*rows.columns), F.lit(chunks)).cast("int"))

    one = model.select("slices").first()
    slices = one["slices"] if one else 1
    groups = 1 + chunks // CHUNKS

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        keys, chunk = keys_of(part["_raw"].tolist()), int(part["_chunk"].iloc[0])
        return packed_steps(keys, np.ones(len(keys), np.int16), slices).assign(_chunk=chunk, _group=chunk % groups)

    def answer(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own):
            known, steps = steps_of(own["data"].iloc[0])
            for chunk, data in zip(asked["_chunk"], asked["data"], strict=True):
                keys, _ = steps_of(data)
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                found = known[at] == keys
                out.append((chunk, int(own["slice"].iloc[0]), slice_bytes(keys[found], steps[at[found]])))
        return pd.DataFrame(out, columns=["chunk", "slice", "data"])

    asked = parted.groupBy("_chunk").applyInPandas(ask, "_chunk int, _group int, slice int, data binary")
    shared = model.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), "slice", "data")
    answers = asked.groupBy("_group", "slice").cogroup(shared.groupBy("_group", "slice")).applyInPandas(answer, "chunk int, slice int, data binary")

    def score(part: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        return run(part.drop(columns="_chunk"), evidence(part["_raw"].tolist(), Steps([steps_of(d) for d in got.sort_values("slice")["data"]])))

    return parted.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, schema)
