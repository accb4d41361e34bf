"""Best-fit packing of tokenized documents into sequences of a fixed length.

Longer documents are cut into full sequences and a rest. What is packed are the rests: bulk-synchronous best fit over pieces and gaps
that are sorted by length, each piece and gap known by its length and its rank among those of equal length.

One round is a sweep over the piece lengths, the longest first. A length's successor is the smallest gap that holds
it. Conflicts are resolved by rank: with m such gaps, the m pieces of the lowest ranks take them, the next pieces take the next
larger gaps, and those without a gap open new sequences; then the gaps are updated. Each sweep thus places
whole ranges of ranks at once, and the result is that of best-fit decreasing. A sweep needs only how many
pieces have each length: at most ``size`` numbers, whatever the corpus. The rows themselves stay distributed: each
finds its range, and so its sequence and offset, by its length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, lean, materialize, prepare, table
from .tokens import Encoder, encoder, tokenizer_path, with_end


def sweeps(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset) of ranges of pieces: the i-th piece of a range goes into the i-th
    sequence from the first one on, at the offset."""
    gaps: dict[int, deque] = defaultdict(deque)  # by gap: ranges (first sequence, sequences)
    order: list[int] = []  # the gaps that there are, ascending
    out, opened = [], 0

    def free(gap: int, first: int, n: int) -> None:
        if gap:
            if not gaps[gap]:
                insort(order, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(order, length)
            if i < len(order):
                gap = order[i]
                first, n = gaps[gap].popleft()
                take = min(n, left)
                if take < n:
                    gaps[gap].appendleft((first + take, n - take))
                elif not gaps[gap]:
                    order.pop(i)
            else:
                gap, first = size, opened
                take = -(-left // (size // length))
                opened += take
            out.append((length, rank, take, first, size - gap))
            free(gap - length, first, take)
            rank, left = rank + take, left - take
    return out


def cut_pieces(path: str, size: int, end_id: int, keep_pieces: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, False) if keep_pieces else Encoder(path, False)
        for part in parts:
            ids, counts = with_end(*enc.encode(part["raw"].tolist()), end_id)
            ids, ends = ids.astype("<u4"), np.cumsum(counts)
            out = []
            for row, a, b in zip(part["_row"], ends - counts, ends, strict=True):
                for k, lo in enumerate(range(int(a), int(b), size)):
                    hi = min(lo + size, int(b))
                    out.append((row, k, lo - int(a), hi - lo, zlib.crc32(ids[lo:hi])))
            yield pd.DataFrame(out, columns=["_row", "piece", "start", "length", "ids_crc32"]).astype({"_row": part["_row"].dtype})

    return run


def place(plan):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first_rank, first_seq, offset = plan.value
        for part in parts:
            rank = part.pop("_rank").to_numpy(np.int64)
            i = np.searchsorted(key, part["length"].to_numpy(np.int64) << 44 | rank, side="right") - 1
            part["sequence_id"] = first_seq[i] + rank - first_rank[i]
            part["offset"] = offset[i]
            yield part

    return run


def pack_best_fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, tokenizer: str | None = None, end_id: int = 0, salts: int = 64, keep_pieces: bool = True) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row of docs.

    Null text counts as empty (one piece, the end id alone); rows of equal ids are documents of their own; an empty table gives
    no rows; other columns are ignored. With ``keep_pieces`` a Python worker keeps the words that it has
    encoded from task to task.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_row"), as_bytes(F.col(text_col)).alias("raw"))
    pieces = materialize(rows.mapInPandas(lean(cut_pieces(path, size, end_id, keep_pieces)), f"_row {kind}, piece int, start long, length long, ids_crc32 long"))

    # Ranks within a length: numbered within (length, salt), so that a common length is dealt to many tasks.
    fields = ["_row", "piece", "start", "ids_crc32"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*fields), F.lit(salts)))
    counted = {(r["length"], r["_salt"]): r["count"] for r in salted.groupBy("length", "_salt").count().collect()}  # at most size x salts numbers
    totals, before = defaultdict(int), {}
    for length, salt in sorted(counted):
        before[length, salt] = totals[length]
        totals[length] += counted[length, salt]
    shift = spark.createDataFrame([(k, s, n) for (k, s), n in before.items()], "length long, _salt long, _before long")
    ranked = salted.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*fields)) - 1)
    ranked = ranked.join(shift, ["length", "_salt"]).select(*fields[:3], "length", "ids_crc32", (F.col("_in") + F.col("_before")).alias("_rank"))

    plan = np.array(sorted(sweeps(dict(totals), size)) or [(0, 0, 0, 0, 0)], np.int64)  # at most a few ranges for each pair of length and gap
    plan = spark.sparkContext.broadcast((plan[:, 0] << 44 | plan[:, 1], plan[:, 1], plan[:, 3], plan[:, 4]))
    out = ranked.mapInPandas(lean(place(plan)), f"_row {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("_row", id_col)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"))
