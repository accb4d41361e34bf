"""Repeated windows in a corpus of sequences (bytes or words): what suffix dedup and substring dedup share.

A window is ``size`` consecutive symbols of one document. Equal windows are found without moving windows about:

1. Every window has an anchor: the seed of ``seed`` symbols inside it with the least hash (the leftmost of ties). Which
   seed that is depends on the window's symbols alone, so equal windows have equal anchors at equal offsets, and every
   pair of equal windows meets at its anchor. Neighbouring windows mostly share their anchor; such a run of windows is
   one row, with a hash of its anchor and one of its block, the symbols that its windows cover.
2. Only runs whose anchor occurs more than once go on. Runs of equal blocks form a class: all their windows are repeated.
3. Where blocks of one anchor differ (a repeated passage begins or ends there), one run of each class is taken apart
   into its windows, which are named by their hashes and counted.

Steps 1 and 3 read texts and send out rows of a few numbers; counts are partly summed before each shuffle, joins may be
split by adaptive execution, no group is gathered in one task.

What is settled by names is settled by 126 bits: a 64-bit hash, mixed from a polynomial modulo 2^64, and a check of 62 bits, the values of two polynomials modulo
primes of 31 bits. Bytes are turned into random 64-bit symbols. Polynomials modulo 2^64 are equal for some built sequences of two symbols (of 1,024 and more), so a word's symbol is mixed from its polynomial and from the values
modulo both primes, and its check has a symbol of its own from the primes alone. Anchors have 64 bits; two that collide only make more candidates.
Rows are known by their id and 96 bits of their text, so that rows of null or equal ids keep apart; rows equal in both have equal spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean, materialize, only_near, prepare

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
CHUNK = 1 << 18
PLACE_BITS = U(20)
BLANKS = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
PRIMES = (2**31 - 1, 2**31 - 19)
BYTE_VALUES = np.random.default_rng(11).integers(1, 2**64, 256, dtype=U)

ROW = "_d long, _h long, _g int"
KEYS = ("_d", "_h", "_g")


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


@cache
def prime_powers(n: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """For each prime the powers of a base, and of its inverse."""
    out = []
    for prime, base in zip(PRIMES, (1_234_567_891, 987_654_321), strict=True):
        pair = []
        for b in (base, pow(base, -1, prime)):
            p, known = np.ones(n, U), 1
            while known < n:  # each pass doubles what is known
                step = U(pow(b, known, prime))
                p[known : 2 * known] = p[: min(known, n - known)] * step % U(prime)
                known *= 2
            pair.append(p)
        out.append(tuple(pair))
    return tuple(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Hashes:
    """Hashes of any run of symbols, equal for equal symbols wherever they stand."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        size = max(2 * CHUNK, 1 << n.bit_length())
        self.power, self.inverse = powers(size)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(symbols * self.power[:n], dtype=U, out=self.sums[1:])

    def of(self, start, end):
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, U)


class Checks:
    """A second name of runs of symbols: 62 bits, by two primes."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.parts = []
        for prime, (power, inverse) in zip(PRIMES, prime_powers(max(2 * CHUNK, 1 << n.bit_length())), strict=True):
            sums = np.zeros(n + 1, U)
            np.cumsum(symbols % U(prime) * power[:n] % U(prime), dtype=U, out=sums[1:])
            self.parts.append((U(prime), sums, inverse))

    def of(self, start, end) -> np.ndarray:
        """As a non-negative int64."""
        a, b = ((sums[end] - sums[start]) % prime * inverse[start] % prime for prime, sums, inverse in self.parts)
        return (a << U(31) | b).view(np.int64)


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts one after another, those for checks, and each text's number of symbols."""
    symbols = BYTE_VALUES[np.frombuffer(b"".join(texts), np.uint8)]
    return symbols, symbols, np.array([len(t) for t in texts], np.int64)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate(([False], ~BLANKS[buf], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One symbol a word, for shingles and sketches."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, end = word_bounds(buf)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    out = [np.zeros(0, U)]
    for lo in range(0, len(start), CHUNK // 8):  # word by word in chunks that the power table covers
        s, e = start[lo : lo + CHUNK // 8], end[lo : lo + CHUNK // 8]
        h = Hashes(BYTE_VALUES[buf[s[0] : e[-1]]])
        out.append(h.of(s - s[0], e - s[0]) ^ mix((e - s).astype(U)))
    return np.concatenate(out), counts.astype(np.int64)


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As byte_symbols, for words: both symbols hold what tells words apart, by different means."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, end = word_bounds(buf)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    out, checks = [np.zeros(0, U)], [np.zeros(0, U)]
    for lo in range(0, len(start), CHUNK // 8):  # word by word in chunks that the power table covers
        s, e = start[lo : lo + CHUNK // 8], end[lo : lo + CHUNK // 8]
        values = BYTE_VALUES[buf[s[0] : e[-1]]]
        size = mix((e - s).astype(U))
        check = mix(Checks(values).of(s - s[0], e - s[0]).view(U) ^ size)
        out.append(mix(Hashes(values).of(s - s[0], e - s[0]) ^ size) ^ check)
        checks.append(check)
    return np.concatenate(out), np.concatenate(checks), counts.astype(np.int64)


def runs_of(symbols: np.ndarray, check_symbols: np.ndarray, counts: np.ndarray, size: int, seed: int):
    """text number, first window, windows, anchor hash, block hash and its check, of each run of windows that share their anchor."""
    first = np.concatenate(([0], np.cumsum(counts)))
    total, span = len(symbols), size - seed + 1
    last = np.full(total, -1, np.int64)  # of each symbol: the last window start of its text
    for t in np.flatnonzero(counts >= size):
        last[first[t] : first[t + 1]] = first[t + 1] - size
    out = []
    for lo in range(0, max(0, total - size + 1), CHUNK):
        part = symbols[lo : lo + CHUNK + size - 1]
        n = len(part) - size + 1
        valid = last[lo : lo + n] >= np.arange(lo, lo + n)
        if not valid.any():
            continue
        hashes = Hashes(part)
        seeds = hashes.all(seed)
        m = -(-len(seeds) // span) * span
        v = np.full(m, ~U(0), U)
        v[: len(seeds)] = seeds >> PLACE_BITS << PLACE_BITS | np.arange(len(seeds), dtype=U)
        v = v.reshape(-1, span)
        ahead = np.minimum.accumulate(v, axis=1).reshape(-1)
        behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        anchor = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & ((U(1) << PLACE_BITS) - U(1))).astype(np.int64)
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~valid[:-1])) & valid
        start = np.flatnonzero(new)
        ends = np.flatnonzero(valid & np.concatenate((new[1:] | ~valid[1:], [True])))
        a = anchor[start]
        block = mix(hashes.of(start, ends + size) + mix(((a - start) << 32 | ends - start).astype(U)))
        text = np.searchsorted(first, start + lo, side="right") - 1
        out.append((text, start + lo - first[text], ends - start + 1, seeds[a], block, Checks(check_symbols[lo : lo + CHUNK + size - 1]).of(start, ends + size)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def cut_name(x: np.ndarray, bits: int) -> np.ndarray:
    return (x & U((1 << bits) - 1)).view(np.int64)


def find_runs(symbols_of: Callable, size: int, seed: int, bits: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part[part["raw"].map(len) >= size]
            if len(part):
                text, start, n, key, block, check = runs_of(*symbols_of(part["raw"].tolist()), size, seed)
                yield pd.DataFrame({"_d": part["_d"].to_numpy()[text], "_h": part["_h"].to_numpy()[text], "_g": part["_g"].to_numpy()[text], "start": start.astype(np.int32), "n": n.astype(np.int32), "key": cut_name(key, bits), "block": cut_name(block, bits), "check": check})

    return run


def name_windows(symbols_of: Callable, size: int, bits: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for d, h, g, raw, todo in zip(part["_d"], part["_h"], part["_g"], part["raw"], part["todo"], strict=True):
                symbols, check_symbols, _ = symbols_of([raw])
                hashes, checks = Hashes(symbols), Checks(check_symbols)
                todo = np.asarray(todo, np.int64)
                for own in (True, False):
                    at = [np.arange(x >> 32, (x >> 32) + (x >> 1 & 0x7FFFFFFF)) for x in todo[(todo & 1) == own]]
                    if at:
                        at = np.concatenate(at)
                        yield pd.DataFrame({"_d": d, "_h": h, "_g": g, "start": at.astype(np.int32), "own": own, "window": cut_name(hashes.of(at, at + size), bits), "check": checks.of(at, at + size)})

    return run


def take_blocks(size: int):
    """mapInPandas function: the bytes that the windows of each run cover."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for d, h, g, raw, todo, keys in zip(part["_d"], part["_h"], part["_g"], part["raw"], part["todo"], part["keys"], strict=True):
                for x, key in zip(todo, keys, strict=True):
                    start, n = int(x) >> 32, (int(x) >> 1) & 0x7FFFFFFF
                    out.append((d, h, g, start, n, bool(x & 1), int(key), raw[start : start + n + size - 1]))
            yield pd.DataFrame(out, columns=["_d", "_h", "_g", "start", "n", "own", "key", "block"])

    return run


def ranks(*columns: np.ndarray) -> np.ndarray:
    """The rank of each row of the columns among the distinct rows."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        c = np.unique(c, return_inverse=True)[1]
        out = np.unique(out * (c.max(initial=0) + 1) + c, return_inverse=True)[1]
    return out


def load8(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The next ``size`` (0 to 8) bytes from each place, as a big-endian number."""
    out = np.zeros(len(at), U)
    for i in range(8):
        out = out << U(8) | np.where(i < size, text[np.minimum(at + i, len(text) - 1)], 0).astype(U)
    return out


STEP = 16


def sort_suffixes(text: np.ndarray, bucket: np.ndarray, offset: np.ndarray, at: np.ndarray, covers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``at`` to a depth of ``size`` bytes, bucket by bucket, and which of them in that order equal the one before.

    A suffix's bucket is its anchor's and its offset from the anchor. covers: the places of text at multiples of STEP from their
    anchors, ascending. The ranks of these samples to the needed depth come first, by doubling; a suffix is then
    its few bytes before the next sample, that sample's rank, and its few last bytes.
    """
    depth = (size - STEP) // STEP * STEP
    rank = ranks(load8(text, covers, np.full(len(covers), 8)), load8(text, covers + 8, np.full(len(covers), 8)))
    known, done = STEP, {STEP: rank}
    while known * 2 <= depth:
        rank = ranks(rank, after(covers, rank, known))
        known *= 2
        done[known] = rank
    total, left = rank, depth - known
    at_depth = known
    for width in sorted(done, reverse=True):
        if left >= width:
            total = ranks(total, after(covers, done[width], at_depth))
            at_depth, left = at_depth + width, left - width
    i = np.searchsorted(covers, at)
    head = covers[i] - at
    tail_at, tail = covers[i] + depth, at + size - covers[i] - depth
    keys = (bucket, offset, load8(text, at, np.minimum(head, 8)), load8(text, at + 8, np.clip(head - 8, 0, 8)), total[i])
    keys += tuple(load8(text, tail_at + k, np.clip(tail - k, 0, 8)) for k in range(0, 2 * STEP, 8))
    order = np.lexsort(keys[::-1])
    same = np.ones(len(at), bool)
    same[:1] = False
    for k in keys:
        k = k[order]
        same[1:] &= k[1:] == k[:-1]
    return order, same


def after(covers: np.ndarray, rank: np.ndarray, step: int) -> np.ndarray:
    """The rank of the sample that stands ``step`` further on, or -1."""
    i = np.searchsorted(covers, covers + step)
    i[i == len(covers)] = 0
    return np.where(covers[i] == covers + step, rank[i], -1)


def sort_buckets(size: int, seed: int, most_bytes: int = 1 << 19):
    """mapInPandas function over blocks that are sorted by bucket: the spans of repeated windows."""

    def solve(rows: list[tuple]) -> pd.DataFrame:
        blocks = [r[7] for r in rows]
        n = np.array([r[4] for r in rows], np.int64)
        lens = np.array([len(b) for b in blocks], np.int64)
        base = np.cumsum(lens) - lens
        text = np.frombuffer(b"".join(blocks), np.uint8)
        # where the anchor stands: all windows of a block hold it, so it is the least seed of the block's first window
        bucket, anchor = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        span = size - seed + 1
        seeds = Hashes(BYTE_VALUES[text]).all(seed)
        which = {}
        for j, r in enumerate(rows):
            bucket[j] = which.setdefault(r[6], len(which))
            v = seeds[base[j] : base[j] + span] >> PLACE_BITS
            anchor[j] = int(np.argmin(v))
        row = np.repeat(np.arange(len(rows)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base[row]
        place = np.arange(len(text)) - np.repeat(base + anchor, lens)
        covers = np.flatnonzero(place % STEP == 0)
        order, same = sort_suffixes(text, bucket[row], base[row] + anchor[row] - at, at, covers, size)
        hit = np.zeros(len(at), bool)
        hit[order] = same | np.append(same[1:], False)
        own = np.array([r[5] for r in rows])
        hit &= own[row]
        first = hit & ~(np.append(False, hit[:-1]) & np.append(False, row[1:] == row[:-1]))
        last = hit & ~(np.append(hit[1:], False) & np.append(row[1:] == row[:-1], False))
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        start = np.array([r[3] for r in rows], np.int64)
        lo = start[row[a]] + at[a] - base[row[a]]
        return pd.DataFrame({"_d": [rows[j][0] for j in row[a]], "_h": [rows[j][1] for j in row[a]], "_g": [rows[j][2] for j in row[a]], "lo": lo.astype(np.int32), "hi": (lo + (b - a) + size).astype(np.int32)})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for part in parts:
            for r in part[["_d", "_h", "_g", "start", "n", "own", "key", "block"]].itertuples(index=False, name=None):
                if held > most_bytes and r[6] != rows[-1][6]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[7])
        if rows:
            yield solve(rows)

    return run


def with_keys(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """_d: the id (the least number for null); _h and _g tell rows of equal ids apart by their texts; raw: the bytes; _k0 ...: the columns to keep."""
    raw = as_bytes(F.col(text_col))
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_d"), F.xxhash64(raw).alias("_h"), F.hash(raw).alias("_g"), raw.alias("raw"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])


def repeated_spans(rows: DataFrame, symbols_of: Callable, size: int, seed: int, first_stays: bool, sort_up_to: int = 0, name_bits: int = 64) -> DataFrame:
    """_d, _h, _g and the arrays lo and hi: where spans that repeated windows cover begin and end, for the rows that have any.

    first_stays False: a window is repeated if it starts at any other place too. True: if it also starts in a row
    with a smaller _d. Anchors with at most ``sort_up_to`` different blocks (bytes only) are resolved by sorting these blocks'
    suffixes in one task, bucket by bucket; larger ones by counting names of windows, which has no group to gather. Names cut to
    name_bits collide, but their checks tell them apart (a means of tests).
    """
    prepare(rows.sparkSession)
    texts = rows.select(*KEYS, "raw").filter(F.length("raw") >= size)
    runs = materialize(texts.mapInPandas(lean(find_runs(symbols_of, size, seed, name_bits)), ROW + ", start int, n int, key long, block long, check long"))
    shared = materialize(runs.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), narrow=True)  # written, so that the joins' sides are plain shuffles, which can be split
    runs = materialize(runs.join(shared, "key"), narrow=True)
    place = F.struct(*KEYS, "start")
    classes = materialize(runs.groupBy("key", "block", "check", "n").agg(F.count("*").alias("c"), F.min(place).alias("rep")), narrow=True)
    mixed = materialize(classes.groupBy("key").agg(F.count("*").alias("classes")).filter("classes > 1"), narrow=True)
    classes = materialize(classes.join(mixed, "key", "left").filter("c > 1 or classes > 1").select("key", "block", "check", "n", "c", "rep", F.coalesce("classes", F.lit(1)).alias("classes")), narrow=True)
    known = runs.join(classes, ["key", "block", "check", "n"])
    if first_stays:
        whole, todo = F.col("_d") > F.col("rep._d"), (F.col("classes") > 1) & (F.col("_d") == F.col("rep._d"))
        own: Column = F.lit(True)
    else:
        whole, todo = F.col("c") > 1, (F.col("classes") > 1) & (place == F.col("rep"))
        own = F.col("c") == 1
    known = materialize(known.select(*KEYS, "start", "n", "key", "classes", whole.alias("whole"), todo.alias("todo"), own.alias("own")).filter("whole or todo"), narrow=True)
    marks = known.filter("whole").select(*KEYS, F.col("start").alias("lo"), (F.col("start") + F.col("n") + (size - 1)).alias("hi"))
    todo = known.filter("todo")
    packed = F.expr("cast(start as long) * 4294967296 + n * 2 + cast(own as int)")

    if sort_up_to:
        few = todo.filter(F.col("classes") <= sort_up_to)
        todo = todo.filter(F.col("classes") > sort_up_to)
        pairs = few.groupBy(*KEYS).agg(F.collect_list(F.struct(packed.alias("todo"), F.col("key"))).alias("pairs"))
        pairs = pairs.select(*KEYS, F.col("pairs.todo").alias("todo"), F.col("pairs.key").alias("keys"))
        blocks = only_near(texts, few, *KEYS).join(pairs.hint("shuffle_hash"), list(KEYS))
        blocks = blocks.mapInPandas(lean(take_blocks(size)), ROW + ", start int, n int, own boolean, key long, block binary")
        spans = blocks.repartition("key").sortWithinPartitions("key").mapInPandas(lean(sort_buckets(size, seed)), ROW + ", lo int, hi int")
        marks = marks.unionByName(spans)

    named = only_near(texts, todo, *KEYS).join(todo.groupBy(*KEYS).agg(F.collect_list(packed).alias("todo")).hint("shuffle_hash"), list(KEYS))
    windows = materialize(named.mapInPandas(lean(name_windows(symbols_of, size, name_bits)), ROW + ", start int, own boolean, window long, check long"))
    names = windows.groupBy("window", "check")
    if first_stays:
        names = names.agg(F.min("_d").alias("least"), F.max("_d").alias("most")).filter("least < most").select("window", "check", "least")
        hit = windows.join(names, ["window", "check"]).filter("_d > least")
    else:
        names = names.agg(F.count("*").alias("c")).filter("c > 1").select("window", "check")
        hit = windows.filter("own").join(names, ["window", "check"])
    marks = marks.unionByName(hit.select(*KEYS, F.col("start").alias("lo"), (F.col("start") + size).alias("hi")))
    return marks.groupBy(*KEYS).agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows with lo and hi, null where there are none."""
    spans = materialize(spans)
    return rows.join(spans.hint("shuffle_hash"), list(KEYS), "left")


def covered(n: int, lo, hi) -> np.ndarray:
    """Which of n symbols lie in a span."""
    change = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
    return np.cumsum(change[:-1]) > 0
