"""Removal of every byte that a repeated 400-byte string covers, over all documents.

The suffixes that could be repeated are found bucket by bucket (see ``repeats``): a bucket is the suffixes whose first
``size`` bytes hold the same anchor at the same place, so suffixes equal to that depth share a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table
from .repeats import byte_symbols, covered, repeated_spans, with_keys, with_spans


def cut(texts: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n, removed, spans, digest, kept = [], [], [], [], []
            for raw, lo, hi in zip(part.pop("raw"), part.pop("lo"), part.pop("hi"), strict=True):
                n.append(len(raw))
                if lo is None or not len(lo):
                    removed.append(0), spans.append(0)
                else:
                    gone = covered(len(raw), lo, hi)
                    removed.append(int(gone.sum()))
                    spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                digest.append(hashlib.sha256(raw).hexdigest())
                if texts:
                    kept.append(raw.decode(errors="ignore"))
            part["n_bytes"], part["n_removed"], part["n_spans"], part["kept_sha256"] = n, removed, spans, digest
            if texts:
                part["kept"] = kept
            yield part

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 400, seed: int = 128, sort_up_to: int = 2000, keep: tuple[str, ...] = (), texts: bool = True, name_bits: int = 64) -> DataFrame:
    """One row for each row of ``docs``: id_col, the columns in ``keep``, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay) and, with
    ``texts``, kept: these bytes as text, without those of letters that were cut apart.

    A byte goes if a ``size``-byte string over it also starts anywhere else, in the same document or another. Null counts as
    empty; rows of equal id and text are documents of their own (so copies of each other); an empty table gives none; other
    columns are ignored.
    """
    rows = with_keys(docs, id_col, text_col, keep)
    spans = repeated_spans(rows, byte_symbols, size, seed, first_stays=False, sort_up_to=sort_up_to, name_bits=name_bits)
    extra = [f"_k{i}" for i in range(len(keep))]
    joined = with_spans(rows, spans).select("_id", *extra, "raw", "lo", "hi")
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in joined.schema[: 1 + len(keep)])
    out = joined.mapInPandas(lean(cut(texts)), schema + "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * texts)
    return out.withColumnsRenamed({"_id": id_col} | dict(zip(extra, keep, strict=True)))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)
