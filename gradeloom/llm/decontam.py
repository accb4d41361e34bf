"""Benchmark decontamination: which words of a document lie inside a window of a benchmark item.

A prefix-filtered set join. Windows of an item are sets of positioned shingles; the shingles are ordered by rarity (the
number of documents that hold them, over all documents), and a window can only occur where its rarest shingle, its
prefix, occurs: for full containment one prefix token is enough. Candidates pass the length and position bounds
(the whole window has to fit into the document at the place the prefix dictates) and are then verified exactly, shingle by
shingle, at consecutive places.

Words are numbered by a dictionary of the benchmark's words; a shingle's code is a number built from its word numbers
without loss, so no hash collision can make a false match.

The benchmark is cut into blocks of about ``block_words`` words (an item is never cut). Each block is a pass of its own over the documents: its dictionary, window
table and counts are gathered, broadcast and given up before the next one's, so memory is bounded by that parameter whatever
the benchmark's size, and a benchmark of n blocks costs n readings. Documents are not shuffled; with several blocks, what they hit is put together by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, lean, materialize, prepare, table

#: One byte to one: A-Z lowered, digits, a-z and bytes from 0x80 kept, all else a blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after A-Z are lowered."""
    return raw.translate(WORD_BYTES).split()


@dataclass
class Block:
    """Windows of some items. A window is given by its word numbers; windows of equal words are one."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    windows: list[tuple[int, ...]] = field(default_factory=list)
    items: list[list[str]] = field(default_factory=list)
    #: by shingle width: the sorted codes, and the global number of the first one
    codes: dict[int, np.ndarray] = field(default_factory=dict)
    first: dict[int, int] = field(default_factory=dict)

    def base(self) -> int:
        return len(self.numbers) + 1


def shingle_codes(numbers: np.ndarray, width: int, base: int) -> np.ndarray:
    """A code for each run of ``width`` word numbers; 0 where a word is unknown."""
    n = len(numbers) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code, known = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(width):
        part = numbers[i : i + n]
        code = code * base + part
        known &= part > 0
    return np.where(known, code, 0)


def make_blocks(items: list[tuple[str, bytes]], window: int, width: int, first: int) -> Block:
    """The block of the items given; ``first`` is the first free shingle number."""
    block, place = Block(), {}
    for item, raw in items:
        ws = words_of(raw)
        if not ws:
            continue
        seq = [block.numbers.setdefault(w, len(block.numbers) + 1) for w in ws]
        size = min(window, len(seq))
        for i in range(len(seq) - size + 1):
            key = tuple(seq[i : i + size])
            if key not in place:
                place[key] = len(block.windows)
                block.windows.append(key)
                block.items.append([])
            if item not in block.items[place[key]][-1:]:
                block.items[place[key]].append(item)
    base = block.base()
    while width > 1 and base**width >= 2**62:
        width -= 1
    for key in block.windows:
        w = min(width, len(key))
        block.codes.setdefault(w, []).append(shingle_codes(np.array(key, np.int64), w, base))
    for w in sorted(block.codes):
        block.codes[w] = np.unique(np.concatenate(block.codes[w]))
        block.first[w], first = first, first + len(block.codes[w])
    return block


def size_of(block: Block) -> int:
    return sum(map(len, block.codes.values()))


def find_shingles(block):
    """mapInPandas function: in place of raw, the number of words and the places and numbers of the block's shingles."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b: Block = block.value
        base, get = b.base(), b.numbers.get
        for part in parts:
            at, sh, count = [], [], []
            for raw in part.pop("raw"):
                ws = words_of(raw)
                count.append(len(ws))
                numbers = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
                new_at, new_sh = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
                if numbers.any():
                    for w, codes in b.codes.items():
                        got = shingle_codes(numbers, w, base)
                        where = np.flatnonzero(got)
                        i = np.searchsorted(codes, got[where])
                        i[i == len(codes)] = 0
                        ok = codes[i] == got[where]
                        new_at.append(where[ok].astype(np.int32))
                        new_sh.append(i[ok] + b.first[w])
                at.append(np.concatenate(new_at))
                sh.append(np.concatenate(new_sh))
            part["n_words"], part["hit_at"], part["hit_shingle"] = np.array(count, np.int64), at, sh
            yield part

    return run


def join_windows(block, rarity, width: int):
    """mapInPandas function: the prefix join, the bounds and the verification for one block.

    In place of the shingles: span_from and span_to, the occurrences of windows, and items, the items that they belong to.
    """

    def tables():
        b, by_number = block.value, rarity.value
        base = b.base()
        steps, prefix = [], {}
        for n, key in enumerate(b.windows):
            w = next(x for x in range(min(width, len(key)), 0, -1) if x in b.codes and base**x < 2**62)
            numbers = np.searchsorted(b.codes[w], shingle_codes(np.array(key, np.int64), w, base)) + b.first[w]
            steps.append(numbers)
            rare, number, i = min((by_number.get(int(x), 0), int(x), i) for i, x in enumerate(numbers))
            if rare:  # a shingle that no document holds rules its window out
                prefix.setdefault(number, []).append((n, i))
        return b, steps, prefix

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, steps, prefix = tables()
        rare = np.array(sorted(prefix), np.int64)
        for part in parts:
            lo, hi, items = [], [], []
            for n_words, at, sh in zip(part["n_words"], part.pop("hit_at"), part.pop("hit_shingle"), strict=True):
                lo_, hi_, items_ = [], [], set()
                cand = np.flatnonzero(np.isin(sh, rare)) if len(sh) and len(rare) else ()
                if len(cand):
                    there = set(zip(at.tolist(), sh.tolist(), strict=True))
                    for j in cand:
                        for n, i in prefix[int(sh[j])]:
                            start, size = int(at[j]) - i, len(b.windows[n])
                            if start < 0 or start + size > n_words:
                                continue
                            if all((start + k, x) in there for k, x in enumerate(steps[n].tolist())):
                                lo_.append(start)
                                hi_.append(start + size)
                                items_.update(b.items[n])
                lo.append(np.array(lo_, np.int32))
                hi.append(np.array(hi_, np.int32))
                items.append(sorted(items_))
            part["span_from"], part["span_to"], part["items"] = lo, hi, items
            yield part

    return run


def joined_digest(join):
    return lambda parts: digest(join(parts))


def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        hit = []
        for n, lo, hi in zip(part["n_words"], part["span_from"], part["span_to"], strict=True):
            marks = np.zeros(int(n) + 1, np.int32)
            np.add.at(marks, np.asarray(lo, np.int64), 1)
            np.add.at(marks, np.asarray(hi, np.int64), -1)
            hit.append(int((np.cumsum(marks) > 0).sum()))
        part["n_hit"] = np.array(hit, np.int64)
        part["n_items"] = [len(x) for x in part["items"]]
        part["items_sha256"] = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in part["items"]]
        yield part[["_row", "n_words", "n_hit", "n_items", "items_sha256", "span_from", "span_to", "items"]]


def contaminated_words(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 3,
    block_words: int = 500_000,
) -> DataFrame:
    """One row for each row of ``docs``: id_col, n_words, n_hit, n_items, items_sha256, contaminated, span_from, span_to
    (word places of the occurrences), items (the item ids as sorted strings).

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer (but any). Null and empty
    texts have no words; repeated and null ids are kept row by row; an empty benchmark or table of documents gives no hit or no row;
    a null item id counts as the string "null"; other columns of either table are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    bench = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("null")).alias("item"), as_bytes(F.col(item_text_col)).alias("raw"))
    n_words = bench.select(F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()[0] // 4
    n_blocks = max(1, -(-n_words // block_words))
    rows = docs.select(F.col(id_col).alias("_row"), as_bytes(F.col(text_col)).alias("raw"))
    kind = docs.schema[id_col].dataType.simpleString()
    ids = f"_row {kind}"
    if n_blocks > 1:  # rows get numbers, by which the blocks' results are put together
        rows = materialize(rows.withColumn("_no", F.monotonically_increasing_id()).select("_row", "_no", "raw"))
        ids += ", _no long"
    spans = "span_from array<int>, span_to array<int>, items array<string>"
    whole = "n_words long, n_hit long, n_items long, items_sha256 string, " + spans

    def one_pass(k: int) -> DataFrame:
        """Of block k: the digest if it is the only one, else its spans and, with the first block, all rows."""
        items = bench.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k).collect()  # bounded by block_words, or one item
        block = spark.sparkContext.broadcast(make_blocks(sorted((r["item"], bytes(r["raw"])) for r in items), window, shingle, 0))
        found = materialize(rows.mapInPandas(lean(find_shingles(block)), ids + ", n_words long, hit_at array<int>, hit_shingle array<long>"))
        seen = found.select(F.explode(F.array_distinct("hit_shingle")).alias("s")).groupBy("s").count()
        rarity = spark.sparkContext.broadcast({r["s"]: r["count"] for r in seen.collect()})  # of the block's shingles only
        join = join_windows(block, rarity, shingle)
        if n_blocks == 1:
            return found.mapInPandas(lean(joined_digest(join)), f"{ids}, {whole}")
        out = found.mapInPandas(lean(join), f"{ids}, n_words long, {spans}")
        out = materialize(out if k == 0 else out.filter(F.size("span_from") > 0))
        block.destroy()
        rarity.destroy()
        return out

    passes = [one_pass(k) for k in range(n_blocks)]
    if n_blocks == 1:
        out = passes[0]
    else:
        put = lambda c: F.flatten(F.collect_list(c)).alias(c)
        together = reduce(DataFrame.unionByName, passes).groupBy("_no").agg(put("span_from"), put("span_to"), F.array_sort(F.array_distinct(put("items"))).alias("items"))
        out = passes[0].select("_row", "_no", "n_words").join(together, "_no").drop("_no").mapInPandas(lean(digest), f"_row {kind}, {whole}")
    return out.withColumnRenamed("_row", id_col).withColumn("contaminated", F.col("n_hit") > 0)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
