"""The first component of logits and the stacker against numpy; matrices with their labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators.stacking import first_component, shrink_first_component, stack
from gradeloom.sources.tables import matrix_rows


def test_first_component_and_shrinking(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, 1)) @ np.array([[2.0, 1.0, -1.0]]) + rnd.normal(size=(200, 3)) * 0.3 + 0.5
    p = 1 / (1 + np.exp(-x))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id int, a double, b double, c double")
    mean, v, share = first_component(df, ["a", "b", "c"])
    e, w = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs(v @ w[:, -1]), 1) and share == pytest.approx(e[-1] / e.sum())
    out, _ = shrink_first_component(df, ["a", "b", "c"], 0.25)
    got = np.array([r[1:] for r in sorted(map(tuple, out.collect()))])
    want = x - 0.75 * ((x - x.mean(0)) @ w[:, -1:]) @ w[:, -1:].T
    assert np.allclose(np.log(got / (1 - got)), want)
    assert shrink_first_component(df, ["a", "b", "c"], 1.0)[0].filter("id = 7").first()["a"] == pytest.approx(p[7, 0])
    odd = spark.createDataFrame([(1, 0.5, None, 0.5), (2, 0.1, 0.2, 1.0)], df.schema)
    assert odd.count() == shrink_first_component(odd, ["a", "b", "c"], 0.5)[0].count() == 2
    assert first_component(df.limit(0), ["a", "b", "c"])[2] == 0.0


def test_stacker_is_fitted_outside_the_fold(spark):
    """Fold 0 has its labels turned round: a stacker that saw them would follow them."""
    rnd = np.random.default_rng(2)
    rows = [(i, i % 3, float(p), 0.5, int((p > 0.5) != (i % 3 == 0)), 1) for i, p in enumerate(rnd.random(300))]
    df = spark.createDataFrame(rows, "id int, fold int, u double, v double, y_u int, y_v int")
    got = stack(df, ["u", "v"], ["u", "v"], "fold").select("id", "fold", "u", "v").toPandas()
    assert len(got) == 300 and (got["v"] == 1.0).all()  # one class only: its share
    p = {r[0]: r[2] for r in rows}
    zero = got[got["fold"] == 0]
    assert np.corrcoef(zero["u"], [p[i] for i in zero["id"]])[0, 1] > 0.8
    assert stack(df.limit(0), ["u", "v"], ["u", "v"], "fold").count() == 0


def test_matrix_with_other_labels_is_refused(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [0.1, 0.2])], "id int, names array<string>, v array<double>")
    rows = lambda expected: matrix_rows(df, ["id"], F.col("names"), F.col("v"), expected).collect()
    assert [tuple(r) for r in rows(["a", "b"])] == [(1, "a", 0.1), (1, "b", 0.2)]
    for wrong in (["b", "a"], ["a"], ["a", "b", "c"]):
        with pytest.raises(Exception, match="labels are a, b"):
            rows(wrong)
