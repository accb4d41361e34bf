"""Whitening and hard negatives against plain numpy."""

import math

import numpy as np
import pytest

from gradeloom.llm.hard_negatives import Block, hard_negatives
from gradeloom.llm.whitening import WIDE, exact_products, refined_eigenvectors, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, component string, anchor_id string, _v int, _id int"


def table_of(spark, vectors, ids=None, labels=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], 1 if labels is None else labels[i], "x", "y", 3, 4) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def symmetric(values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    q, values = q.astype(WIDE), np.array(values, WIDE)
    q = q @ (1.5 * np.eye(len(values), dtype=WIDE) - 0.5 * q.T @ q)
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    np.arange(1.0, 41), np.geomspace(1e-6, 1e6, 20), [5, 5, 5, 2, 1, 1], [3 + 1e-9, 3, 3 - 1e-9, 1], [1 + 1e-12, 1, 0.5], [7.0], [4, 0, 0, 0], 10 + 1e-10 * np.arange(12),
])
def test_refined_eigenvectors(values):
    a = symmetric(values)
    e, x = refined_eigenvectors(a)
    size = max(np.abs(values))
    assert np.allclose(np.sort(np.array(values, float))[::-1], e.astype(float), rtol=0, atol=1e-14 * size)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-15
    assert np.abs(a @ x - x * e).max() < 2e-15 * size


def test_clusters_reach_the_digits_of_the_gap():
    """Vectors of eigenvalues 10^-9 apart: double precision alone loses half of their digits."""
    a = symmetric([3 + 1e-9, 3, 3 - 1e-9, 1, 0.5])
    e, x = refined_eigenvectors(a)
    assert np.abs(np.diff(e[:3].astype(float)) + 1e-9).max() < 1e-17 * 100
    assert np.abs(x[:, :3].T @ a @ x[:, :3] - np.diag(e[:3])).max() < 1e-17


def test_products_are_exact():
    y = np.random.default_rng(1).integers(-(2**26), 2**26, (40, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert exact_products(y).tolist() == want
    with pytest.raises(ArithmeticError):
        exact_products(np.array([[2**27]]))


def plain_whitening(vectors, components):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return ((n * x - s) ** 2).sum(1), centred @ v / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def test_whiten_equals_numpy(spark):
    vectors = np.random.default_rng(5).normal(size=(300, 7)) * np.arange(1, 8)
    rows = table_of(spark, [*vectors, None, [None] * 7, [math.nan] * 7, [1.0] * 6 + [math.inf], [], [1.0, 2.0]])
    got = whiten(rows, components=5)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.toPandas().sort_values(["vec_id", "component"])
    deviation, whitened, explained = plain_whitening(vectors, 5)
    assert len(got) == 1500 and (got["n"] == 300).all() and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-12
    assert got["deviation"].tolist() == np.repeat(deviation, 5).tolist()
    w = got["whitened"].to_numpy().reshape(300, 5)
    assert np.allclose(w * np.sign((w * whitened).sum(0)), whitened, atol=1e-9)
    assert np.allclose(got["explained"].to_numpy().reshape(300, 5), explained, rtol=1e-10)


def test_whiten_few_rows(spark):
    assert whiten(table_of(spark, [])).count() == 0
    assert whiten(table_of(spark, [[1.0, 2.0]])).count() == 0
    assert whiten(table_of(spark, [[1.0, 2.0]] * 4)).count() == 0
    assert whiten(table_of(spark, [None, []])).count() == 0
    got = whiten(table_of(spark, [[0.0, 1.0], [1.0, 1.0], [1.0, 1.0]], ids=[None, 4, 4])).collect()  # one component, repeated rows, a null id
    assert len(got) == 3 and {r["component"] for r in got} == {1} and all(r["explained"] == 1.0 for r in got)
    assert sorted(abs(round(r["whitened"], 9)) for r in got) == [round(math.sqrt(0.5), 9)] * 2 + [round(math.sqrt(2), 9)]


def plain_negatives(rows, every=100, k=5):
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows]
    out = []
    for i, y, v in sorted({(i, y, tuple(v)) for i, y, v in rows if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in rows if j != i)
        for p, j, _ in [x for x in scored if x[2] == y][:k]:
            found = [(s, m) for s, m, z in scored if z != y and -80 * p <= -100 * s <= -100 * p][:k]
            out += [(i, j, r, m, -p, -s) for r, (s, m) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_hard_negatives_equal_brute_force(spark, block):
    rnd = np.random.default_rng(2)
    vectors = rnd.integers(-4, 5, (400, 19)) / 16.0  # many ties
    vectors[100:220] = vectors[0] + rnd.integers(0, 2, (120, 19)) / 256.0  # a crowd about one anchor
    labels = rnd.integers(0, 3, 400).tolist()
    rows = list(zip(range(400), labels, vectors, strict=True)) + [(50, labels[50], vectors[50]), (200, labels[200], vectors[200]), (20, 1, np.zeros(19))]
    ids, ys, vs = zip(*rows, strict=True)
    extra = [None, [None] * 19, [math.inf] * 19, [0.5] * 18, [0.25] * 19, [0.25] * 19]
    df = table_of(spark, [*vs, *extra], [*ids, 1, 1, 1, 1, None, 1], [*ys, 1, 1, 1, 1, 1, None])
    got = hard_negatives(df, anchor_every=20, relabel=True, block=block, anchors_a_pass=20_000 if block == 64 else 7)
    want = plain_negatives(rows, 20)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_little(spark):
    assert hard_negatives(table_of(spark, [])).count() == 0
    assert hard_negatives(table_of(spark, [[1.0]])).count() == 0
    assert hard_negatives(table_of(spark, [[1.0], [1.0]], [0, 1], [1, 2])).count() == 0  # no positive
    assert hard_negatives(table_of(spark, [[1.0], [1.0]], [1, 2], [1, 1])).count() == 0  # no anchor
    got = hard_negatives(table_of(spark, [[1.0], [1.0], [0.9]], [0, 1, 2], [1, 1, 2])).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 230 * 256)]


def test_scan_reads_fewer_rows_as_bounds_close():
    """Far candidates leave the bitmap before the last columns."""
    rnd = np.random.default_rng(4)
    columns = rnd.integers(-9, 10, (64, 1000))
    columns[:8, 10:] = 0
    columns[:8, :10] = 900
    block = Block(np.arange(1000), np.zeros(1000, np.int64), columns)
    anchor = np.array([500] * 8 + [1] * 56)
    rows, scores = block.scan(anchor, np.arange(1000), -(1 << 62), 1 << 62, 5, np.array([1 << 62]))
    assert set(rows.tolist()) <= set(range(10)) and len(rows) >= 5
    assert scores.tolist() == (anchor @ columns)[rows].tolist()
