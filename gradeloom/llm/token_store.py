"""Token ids in binary shards that are wavelet matrices.

A shard holds the ids of consecutive documents. Its ids are stored as bit planes, from the highest bit down; after each plane the
ids are parted stably, zeros before ones. Each plane has the number of ones before every 512th bit, so that rank needs one
look-up and one short count, and select a binary search. A shard can therefore give the id at a place, count an id in a
range and list its places without decoding the rest.

File: ``GLWM0001``, the length of the header as a 4-byte little-endian number, the header as JSON, then
sections, each compressed by zstd on its own so that a reader takes only those it needs: ``ids`` (int64 document ids), ``null``
(bytes, 1 where the document id is null), ``counts`` (uint32 ids of each document), and ``plane<i>`` and ``rank<i>`` for each bit.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, partitions, prepare, scratch_dir, table, temporary
from .ranges import deal_by_id
from .tokens import encoder, tokenizer_path, with_end

MAGIC = b"GLWM0001"
BLOCK = 512


def pack(tokens: np.ndarray, counts: np.ndarray, ids: np.ndarray, null: np.ndarray) -> bytes:
    bits = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    v = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    sections, zeros = {"ids": ids.astype("<i8"), "null": null.astype(np.uint8), "counts": counts.astype("<u4")}, []
    for level in reversed(range(bits)):
        b = (v & v.dtype.type(1 << level)) != 0
        plane = np.packbits(b)
        ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        sections[f"plane{level}"], sections[f"rank{level}"] = plane, np.concatenate(([0], np.cumsum(ones))).astype("<u4")
        out = np.empty_like(v)
        zeros.append(len(v) - int(ones.sum()))
        np.compress(~b, v, out=out[: zeros[-1]])
        np.compress(b, v, out=out[zeros[-1] :])
        v = out
    packed = {k: zstandard.compress(np.ascontiguousarray(x).tobytes(), 1) for k, x in sections.items()}
    at, places = 0, {}
    for k, x in packed.items():
        places[k] = [at, len(x)]
        at += len(x)
    head = json.dumps({"tokens": len(tokens), "documents": len(counts), "bits": bits, "zeros": zeros[::-1], "sections": places}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(packed.values())


class Shard:
    """Reads a packed shard."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        n = struct.unpack("<I", data[8:12])[0]
        self.head, self.data, self.at = json.loads(data[12 : 12 + n]), data, 12 + n
        self.size, self.bits, self.zeros = self.head["tokens"], self.head["bits"], self.head["zeros"]
        self.planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def section(self, name: str, dtype) -> np.ndarray:
        at, size = self.head["sections"][name]
        return np.frombuffer(zstandard.decompress(self.data[self.at + at : self.at + at + size]), dtype)

    @cached_property
    def counts(self) -> np.ndarray:
        return self.section("counts", "<u4")

    @cached_property
    def documents(self) -> list[int | None]:
        return [None if n else int(x) for x, n in zip(self.section("ids", "<i8"), self.section("null", np.uint8), strict=True)]

    def plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self.planes:
            self.planes[level] = self.section(f"plane{level}", np.uint8), self.section(f"rank{level}", "<u4")
        return self.planes[level]

    def ones(self, level: int, at) -> np.ndarray:
        """The number of ones of a plane before each place."""
        plane, rank = self.plane(level)
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = rank[at // BLOCK].astype(np.int64)
        for i, p in enumerate(at):
            lo = p // BLOCK * (BLOCK // 8)
            out[i] += int(np.unpackbits(plane[lo : (p + 7) // 8])[: p - lo * 8].sum())
        return out

    def token(self, at: int) -> int:
        out = 0
        for level in reversed(range(self.bits)):
            plane, _ = self.plane(level)
            bit = int(plane[at >> 3]) >> (7 - (at & 7)) & 1
            ones = int(self.ones(level, at)[0])
            at = self.zeros[level] + ones if bit else at - ones
            out = out << 1 | bit
        return out

    def bounds(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the token's copies from [lo, hi) stand after the last parting."""
        if token >> self.bits:
            return 0, 0
        for level in reversed(range(self.bits)):
            a, b = (int(x) for x in self.ones(level, [lo, hi]))
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> level & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self.bounds(token, lo, self.size if hi is None else hi)
        return b - a

    def select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        plane, rank = self.plane(level)
        before = rank.astype(np.int64) if bit else np.minimum(np.arange(len(rank)) * BLOCK, self.size) - rank
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(plane[block * BLOCK // 8 : (block + 1) * BLOCK // 8])[: self.size - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def up(self, token: int, p: int) -> int:
        """The place in the text of the token that stands at p after the last parting."""
        for level in range(self.bits):
            bit = token >> level & 1
            p = self.select(level, bit, p - self.zeros[level] if bit else p)
        return p

    def places(self, token: int, lo: int = 0, hi: int | None = None, most: int | None = None) -> list[int]:
        """Where the token stands in [lo, hi), in ascending order; at most the first ``most`` places."""
        a, b = self.bounds(token, lo, self.size if hi is None else hi)
        return [self.up(token, p) for p in range(a, b if most is None else min(b, a + most))]

    def tokens(self) -> np.ndarray:
        """All ids: the partings undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        v = np.zeros(self.size, kind)
        for level in range(self.bits):
            b = np.unpackbits(self.section(f"plane{level}", np.uint8), count=self.size).view(bool)
            out = np.empty(self.size, kind)
            out[np.flatnonzero(~b)] = v[: self.zeros[level]]  # by places: a mask takes several times longer
            out[np.flatnonzero(b)] = v[self.zeros[level] :] | kind(1 << level)
            v = out
        return v


def put_file(uri: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder under a name of its own, then rename it: a task that runs twice does no harm."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    part = f"{root}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{root}/{name}")


def write_shards(folder: str, path: str, end_id: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, at, kept = encoder(path, True), None, []

        def close():
            tokens, counts = (np.concatenate(x) for x in list(zip(*kept, strict=True))[:2])
            keys = pd.concat([x[2] for x in kept])
            put_file(folder, f"{at:08d}.glwm", pack(tokens, counts, keys.fillna(0).to_numpy(np.int64), keys.isna().to_numpy()))
            return pd.DataFrame({"part": [at], "tokens": [len(tokens)], "documents": [len(counts)]})

        for frame in parts:
            for part, rows in frame.groupby("_part", sort=False):
                if part != at:
                    if kept:
                        yield close()
                    at, kept = part, []
                tokens, counts = with_end(*enc.encode(rows["raw"].tolist()), end_id)
                kept.append((tokens.astype(np.uint16) if enc.tokenizer.get_vocab_size() <= 1 << 16 else tokens, counts, rows["_key"].astype("Int64")))
        if kept:
            yield close()

    return run


def write_token_shards(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, parts: int | None = None, shard_bytes: int = 128 << 20) -> DataFrame:
    """Encode docs and write one shard file a part into ``folder``: documents in ascending id order (null ids first, equal ids by text)
    from file to file, in shards of about ``shard_bytes`` bytes of text (a document is never cut) unless ``parts`` says how many. Returns part, tokens, documents and first (ids in the files before it). Null texts count as empty;
    an empty table writes nothing.
    """
    spark = docs.sparkSession
    prepare(spark)
    path, n = tokenizer or tokenizer_path("byte_bpe_50k.json"), partitions(spark)
    if parts is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        parts = max(4 * n, -(-size // shard_bytes))
        n = max(n, parts // 4)
    rows = deal_by_id(docs.select(F.col(id_col), as_bytes(F.col(text_col)).alias("raw")), id_col, parts).drop(id_col)
    rows = rows.repartition(n, "_part").sortWithinPartitions("_part", "_key", "raw")
    done = rows.mapInPandas(write_shards(folder, path, end_id), "part int, tokens long, documents long").collect()  # a row a file
    first, out = 0, []
    for r in sorted(done):
        out.append((r["part"], r["tokens"], r["documents"], first))
        first += r["tokens"]
    return spark.createDataFrame(out, "part int, tokens long, documents long, first long")


def read_shards(first: dict[int, int]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for part, data in zip(frame["part"], frame["content"], strict=True):
                shard = Shard(data)
                tokens, ends = shard.tokens().astype("<u4"), np.cumsum(shard.counts, dtype=np.int64)
                starts = ends - shard.counts
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pd.DataFrame({"_key": pd.array(shard.documents, "Int64"), "start": starts + first[part], "n_tokens": shard.counts.astype(np.int64), "ids_crc32": np.array(crc, np.int64)})

    return run


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """part, content of the shard files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.glwm").load(folder)
    return files.select(F.regexp_extract("path", r"(\d+)\.glwm$", 1).cast("int").alias("part"), "content")


def read_token_shards(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files; index as from write_token_shards."""
    first = {r["part"]: r["first"] for r in index.collect()}
    schema = "_key long, start long, n_tokens long, ids_crc32 long"
    if not first:
        return spark.createDataFrame([], schema).withColumnRenamed("_key", "doc_id")
    return shard_files(spark, folder).mapInPandas(read_shards(first), schema).withColumnRenamed("_key", "doc_id")


def token_places(spark: SparkSession, folder: str, index: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n, first_place: how often each token stands in the shards, and its first place over all files, by rank and select alone."""
    first = {r["part"]: r["first"] for r in index.collect()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for part, data in zip(frame["part"], frame["content"], strict=True):
                shard = Shard(data)
                for t in tokens:
                    if n := shard.count(t):
                        yield pd.DataFrame({"token": [t], "n": [n], "place": [first[part] + shard.places(t, most=1)[0]]})

    found = shard_files(spark, folder).mapInPandas(run, "token int, n long, place long")
    return found.groupBy("token").agg(F.sum("n").alias("n"), F.min("place").alias("first_place"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    index = write_token_shards(table(spark, sf_dir, "documents"), folder)
    return read_token_shards(spark, temporary(spark, folder), index)
