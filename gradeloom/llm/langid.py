"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy.

A text's subwords are the runs of 2 to 4 bytes of its lower-cased words with blanks around them, hashed to 2^15 rows of
embeddings. A text is the average of its subwords' embeddings; a linear softmax over it gives the language. Probabilities are
calibrated by a temperature, and the level below which a text is rejected is set on texts that the training did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, fetch, lean, letters, prepare, table

BITS = 15
WIDTHS = (2, 3, 4)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text that are held as numbers at a time.
CHUNK = 1 << 20


@dataclass
class LanguageModel:
    languages: list[str]
    #: embeddings times output weights, one row a subword bucket: an average of products is the product of the average
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0


def fold(raw: bytes) -> bytes:
    return b" " + b" ".join(raw.translate(LOWER).split()) + b" "


def subwords(folded: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width: the buckets of all texts' subwords, text after text, and the texts' numbers of them."""
    s = np.frombuffer(b"".join(folded), np.uint8).astype(np.uint32)
    lens = np.array([len(f) for f in folded], np.int64)
    ends = np.cumsum(lens)
    for width in WIDTHS:
        n = len(s) - width + 1
        code = np.zeros(max(n, 0), np.uint32)
        for i in range(width):
            code = code << np.uint32(8) | s[i : n + i]
        keep = np.ones(len(code), bool)
        for i in range(1, width):
            x = ends - i
            keep[x[(x >= 0) & (x < len(code))]] = False
        counts = lens - width + 1
        if (counts < 0).any():
            for t in np.flatnonzero(lens < width):
                keep[ends[t] - lens[t] : ends[t]] = False
            counts = np.maximum(counts, 0)
        yield ((code[keep] + np.uint32(width)) * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int32), counts


def logits(model: LanguageModel, raws: list[bytes]) -> np.ndarray:
    out, lo = np.zeros((len(raws), len(model.languages))), 0
    folded = [fold(r) for r in raws]
    while lo < len(raws):
        hi, held = lo, 0
        while hi < len(raws) and (hi == lo or held + len(folded[hi]) <= CHUNK):
            held += len(folded[hi])
            hi += 1
        n = np.zeros(hi - lo)
        for bucket, counts in subwords(folded[lo:hi]):
            ends = np.cumsum(counts)
            for k in range(len(model.languages)):
                sums = np.concatenate(([0.0], np.cumsum(model.table[bucket, k], dtype=np.float64)))
                out[lo:hi, k] += sums[ends] - sums[ends - counts]
            n += counts
        out[lo:hi] = out[lo:hi] / np.maximum(n, 1)[:, None] + model.bias
        lo = hi
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def examples(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text as a whole and two short stretches of it, as bucket counts."""
    for part in parts:
        out = []
        for lang, seed, raw in zip(part["lang"], part["seed"], part["raw"], strict=True):
            words, rnd = raw.split(), np.random.default_rng(seed & 0x7FFFFFFF)
            texts = [raw]
            for _ in range(2):
                k = int(rnd.integers(2, 12))
                at = int(rnd.integers(0, max(1, len(words) - k)))
                texts.append(b" ".join(words[at : at + k]))
            for kind, text in enumerate(texts):
                found = np.concatenate([b for b, _ in subwords([fold(text)])])
                if len(found):
                    bucket, n = np.unique(found, return_counts=True)
                    out.append((lang, seed, kind, bucket.astype(np.int32), (n / len(found)).astype(np.float32)))
        yield pd.DataFrame(out, columns=["lang", "seed", "kind", "bucket", "weight"])


def descend(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int, dim: int = 16, epochs: int = 6, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent, a text a step; the embeddings times the output weights, and the bias."""
    rnd = np.random.default_rng(1)
    embed = rnd.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, languages), np.float32), np.zeros(languages, np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rnd.permutation(len(rows)):
            bucket, weight, y = rows[i]
            lr = rate * (1 - step / steps)
            h = weight @ embed[bucket]
            g = softmax(h @ out + bias)
            g[y] -= 1
            back = out @ g
            out -= lr * np.outer(h, g)
            bias -= 0.1 * lr * g
            embed[bucket] -= (lr * 16 * weight)[:, None] * back
            step += 1
    return embed @ out, bias


def train_language_model(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", texts_a_language: int = 400, most_languages: int = 500) -> LanguageModel:
    """Fit on a bounded sample: about texts_a_language different texts of each language, by hash. Rows without a language or a letter are left out.
    At most most_languages languages, those with the most different texts, are learned: the table has 2^15 numbers for each.

    Every fifth text of the sample fits the temperature and the rejection level instead of the weights. The level rejects fewer than
    one in a thousand of the texts whose language is found rightly.
    """
    prepare(labelled.sparkSession)
    text = F.col(text_col)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("seed"), text.alias("text")).filter(F.col("lang").isNotNull() & letters(text))
    texts = rows.groupBy("lang", "seed").agg(F.lit(1).alias("one"))
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit((1 << 62) * min(texts_a_language, n) // n))])
    rows = rows.filter(F.shiftrightunsigned("seed", 2) < share[F.col("lang")]).dropDuplicates(["lang", "seed"])
    found = rows.select("lang", "seed", as_bytes(F.col("text")).alias("raw")).mapInPandas(lean(examples), "lang string, seed long, kind int, bucket array<int>, weight array<float>")
    found = fetch(found)
    found = found.sort_values(["seed", "lang", "kind"])
    number = {x: i for i, x in enumerate(languages)}
    rows = [(b, w, number[x]) for x, b, w in zip(found["lang"], found["bucket"], found["weight"], strict=True)]
    held = (found["seed"] % 5 == 0).to_numpy()
    if not held.any() or held.all():
        held[:] = False
    matrix, bias = descend([r for r, h in zip(rows, held, strict=True) if not h], len(languages))
    model = LanguageModel(languages, matrix.astype(np.float32), bias)
    calibrate(model, [r for r, h in zip(rows, held, strict=True) if h], found["kind"].to_numpy()[held] == 0)
    return model


def calibrate(model: LanguageModel, rows: list, whole: np.ndarray) -> None:
    if not rows:
        return
    x, y = np.stack([w @ model.table[b] + model.bias for b, w, _ in rows]), np.array([r[2] for r in rows])
    grid = np.geomspace(0.05, 5, 60)
    model.temperature = float(grid[np.argmin([-np.log(softmax(x / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid])])
    p = softmax(x / model.temperature)
    right = p[(p.argmax(1) == y) & whole].max(1)
    if len(right) and len(model.languages) > 1:
        # half way from no knowledge at all to the least sure of the texts found rightly, one in a thousand of them apart
        none = 1 / len(model.languages)
        model.reject_below = float(none + 0.5 * (np.quantile(right, 0.001) - none))


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns in ``keep``) with lang_pred (``und`` without a letter), score (the calibrated probability; 0 for ``und``) and rejected (``und``, or a score below
    the level). The whole text counts. Null texts have no letter; without learned languages all are ``und``."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    base = docs.select(*keep, as_bytes(F.col(text_col)).alias("_raw"), letters(F.col(text_col)).alias("_letters"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) + "lang_pred string, score double, rejected boolean"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: LanguageModel = shared.value
        for part in parts:
            raw, ok = part.pop("_raw").tolist(), part.pop("_letters").to_numpy(bool)
            pred, score = np.full(len(raw), "und", object), np.zeros(len(raw))
            if m.languages and ok.any():
                p = softmax(logits(m, [r for r, x in zip(raw, ok, strict=True) if x]) / m.temperature)
                pred[ok] = np.array(m.languages, object)[p.argmax(1)]
                score[ok] = p.max(1)
            part["lang_pred"], part["score"], part["rejected"] = pred, score, ~ok | (pred == "und") | (score < m.reject_below)
            yield part

    return base.mapInPandas(lean(run), schema)


def third(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_language_model(docs.filter(third() != 1))
    out = identify(docs.select("doc_id", "text", F.coalesce(third() == 1, F.lit(False)).alias("held_out")), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
