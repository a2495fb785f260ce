"""Nearest-neighbour information against all pairs in NumPy, with small rectangles and ranges."""

import math

import numpy as np
import pandas as pd
import pytest

from conftest import SF
from tablescope.operators import importance
from tablescope.plans import neighbours

EULER = 0.5772156649015329


def psi(n):
    return np.array([sum(1 / j for j in range(1, int(v))) - EULER for v in np.atleast_1d(n)])


def within(v, r):
    """Rows within the radius of each row: nearer than it, or equal if it is zero."""
    d = np.abs(v[:, None] - v[None, :])
    return (d <= (r * (1 - 1e-9))[:, None]).sum(axis=1)


def two_axes(x, y, k=3):
    x, y = (v / (float(f"{v.std():.12g}") or 1.0) for v in (x, y))
    d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1]
    return max(0, (psi(len(x)) + psi(k))[0] - psi(within(x, r)).mean() - psi(within(y, r)).mean())


def one_axis(x, label, k=3):
    x = x / (float(f"{x.std():.12g}") or 1.0)
    sizes = pd.Series(label).map(pd.Series(label).value_counts()).to_numpy()
    x, label, sizes = x[sizes > 1], np.asarray(label)[sizes > 1], sizes[sizes > 1]
    d = np.abs(x[:, None] - x)
    d[label[:, None] != label] = np.inf
    np.fill_diagonal(d, np.inf)
    need = np.minimum(k, sizes - 1)
    r = np.sort(d, axis=1)[np.arange(len(x)), need - 1]
    return max(0, psi(len(x))[0] + psi(need).mean() - psi(sizes).mean() - psi(within(x, r)).mean())


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 2000
    x = rng.standard_normal(n)
    kind = rng.choice(["a", "b", "c", "d"], n, p=[0.6, 0.3, 0.09, 0.01])
    frame = pd.DataFrame(
        {
            "line": x,
            "noise": rng.standard_normal(n),
            "grid": rng.integers(0, 11, n),  # many ties
            "heavy": np.where(rng.random(n) < 0.4, 7.0, rng.exponential(1e6, n)),  # one value in 40 % of the rows
            "steps": np.round(x * 3).astype(int),
            "same": 5.0,
            "kind": kind,
            "y": x + 0.3 * rng.standard_normal(n) + (kind == "b"),
        }
    )
    frame.loc[n - 1, "kind"] = "once"
    frame.loc[[n - 2, n - 3], "kind"] = "pair"
    return frame


@pytest.mark.parametrize("block", [neighbours.BLOCK, 60])
def test_regression(spark, frame, block):
    method, found = importance.neighbour_information(spark.createDataFrame(frame), "y", digits=12, block=block)
    assert method == "mutual_info_regression"
    scores = {r["feature"]: r["score"] for r in found.collect()}
    for name in ("line", "noise", "grid", "heavy", "steps", "same"):
        assert scores[name] == pytest.approx(two_axes(frame[name].to_numpy(float), frame["y"].to_numpy()), abs=1e-9), name
    assert scores["kind"] == pytest.approx(one_axis(frame["y"].to_numpy(), frame["kind"]), abs=1e-9)
    assert scores["line"] > scores["kind"] > scores["noise"]


@pytest.mark.parametrize("block", [neighbours.BLOCK, 60])
def test_classification(spark, frame, block):
    method, found = importance.neighbour_information(spark.createDataFrame(frame), "kind", digits=12, block=block)
    assert method == "mutual_info_classif"
    for r in found.collect():
        assert r["score"] == pytest.approx(one_axis(frame[r["feature"]].to_numpy(float), frame["kind"]), abs=1e-9), r
    numeric = importance.neighbour_information(spark.createDataFrame(frame), "grid", digits=12, block=block)
    for r in numeric[1].collect():
        name = r["feature"]
        if name == "kind":
            table = pd.crosstab(frame["kind"], frame["grid"]).to_numpy() / len(frame)
            both = table * np.log(np.where(table > 0, table / (table.sum(1, keepdims=True) * table.sum(0)), 1))
            assert r["score"] == pytest.approx(both.sum(), abs=1e-9)
        else:
            assert r["score"] == pytest.approx(one_axis(frame[name].to_numpy(float), frame["grid"]), abs=1e-9), name


def test_partitions_and_gaps(spark, frame):
    gaps = frame.copy()
    gaps.loc[::7, "line"] = np.nan
    gaps.loc[3, "noise"] = np.inf
    df = spark.createDataFrame(gaps)
    one, seven = (importance.neighbour_information(df.repartition(k), "y", digits=9)[1].collect() for k in (1, 7))
    assert one == seven
    whole = frame[~gaps["line"].isna() & np.isfinite(gaps["noise"])]
    score = {r["feature"]: r["score"] for r in one}
    assert score["heavy"] == pytest.approx(two_axes(whole["heavy"].to_numpy(), whole["y"].to_numpy()), abs=1e-8)
    assert importance.neighbour_information(df.limit(10), "y") is None
    assert importance.neighbour_information(df.select("y"), "y") is None


def test_digamma():
    n = np.array([1, 2, 5, 7, 8, 30, 1000])
    assert np.abs(neighbours.digamma(n) - psi(n)).max() < 1e-13
    assert neighbours.digamma(1e12) == pytest.approx(math.log(1e12), abs=1e-9)


def test_importance_estimator(spark, frame):
    df = spark.createDataFrame(frame[["line", "noise", "kind", "y"]])
    found = importance.feature_importance(df, "y", estimator="neighbours").collect()
    assert [r["feature"] for r in found][0] == "line" and found[0]["method"] == "mutual_info_regression"
    with pytest.raises(ValueError, match="estimator"):
        importance.feature_importance(df, "y", estimator="other")


def test_supplied_table(spark):
    frame = pd.read_parquet(f"{SF}/lineitem.parquet").head(1500)[["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]]
    found = importance.neighbour_information(spark.createDataFrame(frame), "l_extendedprice", digits=12, block=100)[1]
    score = {r["feature"]: r["score"] for r in found.collect()}
    price = frame["l_extendedprice"].to_numpy(float)
    assert score["l_quantity"] == pytest.approx(two_axes(frame["l_quantity"].to_numpy(float), price), abs=1e-9)
    assert score["l_returnflag"] == pytest.approx(one_axis(price, frame["l_returnflag"]), abs=1e-9)
