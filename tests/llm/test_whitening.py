"""Whitening against NumPy's eigenvectors and exact integers, and on rows that have no place in it."""

import math

import numpy as np
import pandas as pd
import pytest

from tablescope.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(rows):
    """Result rows by id from (id, vector) pairs with valid vectors."""
    x = [tuple(math.floor(256 * float(c)) for c in v) for _, v in rows]
    fit = np.array(sorted(set(x)), float)
    n, total = len(fit), [int(s) for s in np.array(sorted(set(x)), object).sum(axis=0)]
    mean = fit.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for (key, _), v in zip(rows, x, strict=True):
        far = sum((n * c - s) ** 2 for c, s in zip(v, total, strict=True))
        out[key] = far, (np.array(v) - mean) @ vectors[:, :4] / np.sqrt(values[:4]), values[:4] / values.sum()
    return n, out


def test_op13(spark):
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    rows = [(k, v) for k, v in zip(table.vec_id, table.embedding, strict=True) if v is not None and np.isfinite(v.astype(float)).all()]
    n, expected = plain(rows)
    found = queries.queries()["op13_whitening"](spark, SF).toPandas()
    assert len(found) == 4 * len(rows) and set(found.n) == {n}
    assert found.identity_error.max() == found.identity_error.min() < 1e-9
    signs = {}
    for row in found.itertuples():
        far, white, explained = expected[row.vec_id]
        value = white[row.component - 1]
        sign = signs.setdefault(row.component, np.sign(value * row.whitened))
        assert row.deviation == far and row.whitened * sign == pytest.approx(value, rel=1e-7, abs=1e-9)
        assert row.explained == pytest.approx(explained[row.component - 1], rel=1e-10)


@pytest.mark.parametrize("case", range(7))
def test_leading(case):
    rng = np.random.default_rng(case)
    a = rng.standard_normal((300, [40, 30, 12, 64, 8, 1, 9][case]))
    if case == 1:
        a *= np.logspace(0, -6, 30)
    if case == 2:
        a[:, 3:] = a[:, :1]  # rank three
    v = np.cov(a.T, bias=True).reshape(a.shape[1], -1)
    if case == 4:
        v = np.diag([2.0, 2, 2, 2, 1, 1, 1, 0])
    if case == 6:
        v = np.eye(9) + 1e-3 * np.ones((9, 9))
    values, vectors = whitening.leading(v, 4)
    expected = np.linalg.eigvalsh(v)[::-1][:4]
    assert np.abs(values - expected).max() < 1e-13 * expected[0]
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * expected[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values)))[: np.sum(values > 0), : np.sum(values > 0)].max() < 1e-13


def test_polar():
    a = np.diag([3.0, 1e-9, -2.0])
    assert np.abs(whitening.polar(a) - np.diag([1.0, 1, -1])).max() < 1e-12
    assert whitening.polar(np.zeros((2, 2)) + np.diag([1.0, 0])) is None


ODD = "n long, component string, x int, vec_id string, embedding array<double>"


def test_odd_vectors(spark):
    good = [("a", [0.5, -0.25, 1.0]), ("b", [1.5, 2.0, 0.0]), (None, [0.1, 0.2, -7.0]), ("a", [0.0, 0.004, 3.0]), ("c", [0.5, -0.25, 1.0])]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 0.0, 0.0], [1e300, 0.0, 0.0], [1.0, 2.0]]
    rows = good + [good[1]] + [(f"x{k}", v) for k, v in enumerate(bad)]
    df = spark.createDataFrame([(1, "c", 2, *r) for r in rows], ODD)
    n, expected = plain([(k, v) for k, (_, v) in enumerate(good)])
    found = whitening.whiten(df).toPandas()
    assert len(found) == 6 * 3 and set(found.n) == {4} and n == 4
    first = found[(found.component == 1)]
    assert sorted(first.deviation) == sorted([expected[k][0] for k in range(5)] + [expected[1][0]])
    assert found.identity_error.max() < 1e-9
    white = {(r.vec_id, r.deviation): abs(r.whitened) for r in first.itertuples()}
    for k, (key, _) in enumerate(good):
        assert white[key, expected[k][0]] == pytest.approx(abs(expected[k][1][0]), rel=1e-9)


def test_few_vectors(spark):
    empty = spark.createDataFrame([], ODD)
    assert whitening.whiten(empty).count() == 0
    same = spark.createDataFrame([(1, "c", 2, "a", [1.0, 2.0, 3.0, 4.0, 5.0])] * 3, ODD)
    found = whitening.whiten(same).toPandas()
    assert len(found) == 12 and set(found.n) == {1} and set(found.deviation) == {0}
    assert found[["whitened", "explained", "identity_error"]].isna().all().all()
    two = spark.createDataFrame([(1, "c", 2, "a", [1e9, -1e12]), (1, "c", 2, "b", [0.0, 0.0])], ODD)
    found = whitening.whiten(two).orderBy("vec_id", "component").toPandas()
    assert found.whitened.abs()[0] == pytest.approx(1.0) and np.isnan(found.whitened[1])
    assert (found.deviation.isna() | (found.deviation > 0)).all() and found.identity_error[0] < 1e-9
    # The covariance does not depend on how the rows are spread.
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = (
        whitening.whiten(table.repartition(k)).orderBy("vec_id", "component").toPandas().whitened.to_numpy() for k in (1, 7)
    )
    assert np.abs(a - b).max() < 1e-9
