"""Substring dedup by seed and extend: removal of word passages that a document with a smaller id holds too.

Seeds are winnowed: of the seeds in each window of words the one with the least hash is its anchor. Documents are joined on
their anchors; each match is extended both ways to the block of words that its windows cover, and where blocks
differ, window by window, so that exactly the maximal repeats of at least ``size`` words are found (see ``repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table
from .repeats import covered, repeated_spans, with_keys, with_spans, word_names


def cut(texts: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n, removed, digest, kept = [], [], [], []
            for raw, lo, hi in zip(part.pop("raw"), part.pop("lo"), part.pop("hi"), strict=True):
                words = raw.split()
                n.append(len(words))
                gone = covered(len(words), lo, hi) if lo is not None and len(lo) else np.zeros(len(words), bool)
                removed.append(int(gone.sum()))
                rest = b" ".join(compress(words, ~gone) if removed[-1] else words)
                digest.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    kept.append(rest.decode())
            part["n_words"], part["n_removed"], part["kept_sha256"] = n, removed, digest
            if texts:
                part["kept"] = kept
            yield part

    return run


def remove_copied_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 50, seed: int = 25, texts: bool = True, name_bits: int = 64) -> DataFrame:
    """One row for each row of ``docs``: id_col, n_words, n_removed, kept_sha256 and, with ``texts``, kept (the words that stay).

    A word goes if a window of ``size`` words over it also starts in a document with a smaller id. A null id counts as the smallest,
    rows of equal ids do not remove each other's words, null text counts as empty, an empty table gives none; other
    columns are ignored.
    """
    rows = with_keys(docs, id_col, text_col)
    spans = repeated_spans(rows, word_names, size, seed, first_stays=True, name_bits=name_bits)
    joined = with_spans(rows, spans).select("_id", "raw", "lo", "hi")
    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInPandas(lean(cut(texts)), f"_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
    return out.withColumnRenamed("_id", id_col)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_copied_passages(table(spark, sf_dir, "documents"), texts=False)
