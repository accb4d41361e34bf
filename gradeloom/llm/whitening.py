"""Whitening of embeddings: principal components of the distributed covariance, at double precision.

Vectors become whole numbers, so counts, sums and the covariance's sums of products are exact and do not depend on the order in which tasks end: each task centres its
vectors by the mean rounded to whole numbers, multiplies, and sums; the rest of the centring is done on the sums. The covariance has as many rows as a vector has
entries, whatever the number of vectors, and its eigenvectors are found on the driver, by mixed precision:

1. eigenvectors in float32;
2. Ogita-Aishima refinement: each step corrects all eigenvectors by a few matrix products, first in double and then in extended precision, with quadratic convergence;
3. eigenvalues too close for the corrections to part them make a cluster; a small eigenproblem of the cluster's own, shifted by its mean so that the differences keep their
   digits, turns its vectors, and the refinement goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fetch, table

WIDE = np.longdouble
#: Scale and offset of the whole numbers.
SCALE, OFFSET = 64, 1_000_000
#: Whole numbers up to this size are exact in double precision.
EXACT = 1 << 53


#: A correction of one vector by another above this is no small correction: the two are not parted yet.
SMALL = 1e-3


def correction(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step for x, approximate eigenvectors of a: the corrected x, the eigenvalues, and which pairs of them are not parted (these are only made orthonormal)."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # close eigenvalues would make much of what rounding left between the halves
    values = np.diag(s) / (1 - np.diag(r))
    gap, change = values[None, :] - values[:, None], s + values[None, :] * r
    near = np.abs(change) >= SMALL * np.abs(gap)
    near |= near.T
    step = np.where(near, r / 2, change / np.where(near, 1, gap))
    np.fill_diagonal(near, False)
    return x + x @ step, values, near


def clusters(values: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
    """Runs of eigenvalues that pairs which are not parted hold together."""
    order = np.argsort(values)
    near = near[np.ix_(order, order)]
    reach = np.where(near.any(1), len(near) - 1 - near[:, ::-1].argmax(1), 0)  # the furthest partner
    ends = np.maximum.accumulate(np.maximum(reach, np.arange(len(near))))
    cut = np.flatnonzero(ends == np.arange(len(near))) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def turn(a: np.ndarray, x: np.ndarray, values: np.ndarray, members: np.ndarray) -> np.ndarray:
    """The cluster's vectors turned to the eigenvectors of its own small problem."""
    v = x[:, members]
    own = v.T @ (a @ v - v * values[members].mean())
    scale = np.abs(own).max()
    _, w = np.linalg.eigh((((own + own.T) / 2) / (scale or 1)).astype(np.float64))
    return v @ w.astype(a.dtype)


def refined_eigenvectors(a: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the symmetric matrix a (extended precision), to double precision.

    Vectors of equal eigenvalues are any orthonormal base of their space.
    """
    a = np.asarray(a, WIDE)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(len(a), WIDE), np.eye(len(a), dtype=WIDE)
    a = a / scale
    _, x = np.linalg.eigh(a.astype(np.float32))
    for kind, most in ((np.float64, 3), (WIDE, steps)):
        b, x = a.astype(kind), x.astype(kind)
        for _ in range(most):
            before = x
            x, values, near = correction(b, x)
            members = clusters(values, near)
            for c in members:
                x[:, c] = turn(b, x, values, c)
            if not members and np.abs(x - before).max() <= np.finfo(np.float64).eps / 64:
                break
    x, values, _ = correction(a, x)
    order = np.argsort(-values)
    x = x[:, order]
    return values[order] * scale, x / np.sqrt((x * x).sum(0))


def exact_products(y: np.ndarray) -> np.ndarray:
    """The sum over rows of the outer products of whole numbers, exactly: by double-precision products of as many rows as keep sums exact."""
    top = int(np.abs(y).max(initial=1)) ** 2
    if top > EXACT:
        raise ArithmeticError("entries are too far apart for exact sums")
    rows, total = max(1, EXACT // max(top, 1)), np.zeros((y.shape[1], y.shape[1]), np.int64)
    for lo in range(0, len(y), rows):
        part = y[lo : lo + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def whole_numbers(vectors: pa.Array) -> np.ndarray:
    """x = floor(64 c) + 1000000 of vectors of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = np.floor(SCALE * flat)
    if (np.abs(x) > 1 << 40).any():
        raise ArithmeticError("entries beyond 2^34 have no whole numbers here")
    return x.astype(np.int64) + OFFSET


def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: number of vectors and sums of each dimension."""
    n, total = 0, 0
    for part in parts:
        if len(part):
            total = total + whole_numbers(part.column("_v")).sum(0)
            n += len(part)
    if n:
        yield pa.record_batch({"n": pa.array([n], pa.int64()), "s": pa.array([total], pa.list_(pa.int64()))})


def products(centre: np.ndarray):
    """The rows of the task's sum of products of centred vectors."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            if len(part):
                more = exact_products(whole_numbers(part.column("_v")) - centre)
                total = more if total is None else total + more
        if total is not None:
            yield pa.record_batch({"i": pa.array(np.arange(len(total)), pa.int32()), "g": pa.array(list(total), pa.list_(pa.int64()))})

    return run


def added(parts: DataFrame, key: str, value: str, kind: str) -> DataFrame:
    """key, value: the arrays' sums by place. Places are summed within tasks first, so that a shuffle carries one number a place and task."""
    each = parts.select(key, F.posexplode(value).alias("_j", "_x")).groupBy(key, "_j").agg(F.sum("_x").alias("_x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "_x"))), lambda p: p["_x"].cast(kind)).alias(value))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id, _v: rows whose vector has entries, all of them numbers."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & (F.size(v) > 0)
    return rows.filter(fine).select(F.col(id_col).alias("_id"), v.alias("_v"))


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error for each row and each of the first ``components`` principal components.

    Rows whose vector is null, empty, or holds null, NaN or an infinity take no part; nor do those whose length is not the most frequent one (of equally frequent ones the greatest).
    Equal rows count as often as they occur, and a null id is kept. Components whose eigenvalue is zero to double precision can't be whitened and have no rows: a
    table without rows, of one vector, or of equal vectors gives none. Other columns are ignored. n * deviations that do not fit 63 bits raise an ArithmeticError, as do
    entries beyond 2^34.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = spark.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    rows = usable(rows, id_col, vector_col)
    width = rows.groupBy(F.size("_v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if width is None:
        return empty
    rows = rows.filter(F.size("_v") == width["width"])
    first = added(rows.select("_v").mapInArrow(sums, "n long, s array<long>").select(F.lit(0).alias("one"), F.array_prepend("s", F.col("n")).alias("s")), "one", "s", "long").first()["s"]
    n, total = int(first[0]), [int(x) for x in first[1:]]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    gram = fetch(added(rows.select("_v").mapInArrow(products(centre), "i int, g array<long>"), "i", "g", "long").orderBy("i"))
    rest = [s - n * int(m) for s, m in zip(total, centre, strict=True)]  # n times what the rounded mean left
    exact = [[n * int(g) - a * b for g, b in zip(line, rest, strict=True)] for line, a in zip(gram["g"], rest, strict=True)]
    covariance = np.array([[WIDE(x // n**2) + WIDE(x % n**2) / WIDE(n**2) for x in line] for line in exact], WIDE)
    values, vectors = refined_eigenvectors(covariance)
    trace = np.trace(covariance)
    many = int((values[:components] > len(values) * np.finfo(np.float64).eps * max(values[0], WIDE(0))).sum()) if len(values) else 0
    if not many:
        return empty
    axes = (vectors[:, :many] / np.sqrt(values[:many])).astype(np.float64)
    explained = (values[:many] / trace).astype(np.float64)
    model = spark.sparkContext.broadcast((n, np.array(total, np.int64), axes, explained))

    def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, s, axes, _ = model.value
        top = int(x.max()), int(x.min())
        if len(s) * max(abs(n * top[0] - int(s.min())), abs(n * top[1] - int(s.max()))) ** 2 >= 1 << 63:
            raise ArithmeticError("the deviations do not fit 63 bits")
        d = n * x - s
        return d, (d / n) @ axes

    def moments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of whitened values (first row) and of their products."""
        out = 0
        for part in parts:
            if len(part):
                w = centred(whole_numbers(part.column("_v")))[1]
                out = out + np.vstack([w.sum(0), w.T @ w])
        if not isinstance(out, int):
            yield pa.record_batch({"i": pa.array(np.arange(len(out)), pa.int32()), "g": pa.array(list(out), pa.list_(pa.float64()))})

    m = np.stack(fetch(added(rows.select("_v").mapInArrow(moments, "i int, g array<double>"), "i", "g", "double").orderBy("i"))["g"])
    mean = m[0] / n
    error = float(np.abs(m[1:] / n - np.outer(mean, mean) - np.eye(many)).max())

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, _, axes, explained = model.value
        for part in parts:
            if not len(part):
                continue
            d, w = centred(whole_numbers(part.column("_v")))
            k = axes.shape[1]
            rows = len(part)
            yield pa.record_batch({
                "_id": part.column("_id").take(pa.array(np.repeat(np.arange(rows), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * k, n)),
                "deviation": pa.array(np.repeat((d * d).sum(1), k)),
                "whitened": pa.array(w.reshape(-1)),
                "explained": pa.array(np.tile(explained, rows)),
                "identity_error": pa.array(np.full(rows * k, error)),
            })

    return rows.mapInArrow(project, schema).withColumnRenamed("_id", id_col)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
