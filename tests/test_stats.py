"""Statistics against pandas formulas and published values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions import shape
from tablescope.operators import charts, cluster, importance, stats
from tablescope.operators.clean import clean_table, fill_medians, fill_modes


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame(
        {
            "a": rng.normal(size=n),
            "b": rng.exponential(size=n) ** 2,
            "c": rng.integers(0, 5, n).astype(float),
            "d": np.full(n, 3.0),
        }
    )
    pdf["e"] = pdf["a"] * 2 + rng.normal(size=n) * 0.1
    pdf.loc[::9, "b"] = np.nan
    return pdf


def to_spark(make, pdf):
    rows = [tuple(None if v != v else float(v) for v in row) for row in pdf.itertuples(index=False)]
    return make(rows, ", ".join(f"{c} double" for c in pdf.columns)).repartition(4)


def test_moments_equal_pandas(make, frame):
    found = {r["column"]: r for r in stats.descriptive_stats(to_spark(make, frame), digits=9).collect()}
    for c in frame:
        s, r = frame[c].dropna(), found[c]
        for name, value in {
            "count": len(s), "mean": s.mean(), "std": s.std(), "min": s.min(), "max": s.max(), "median": s.median(),
            "q25": s.quantile(0.25), "q75": s.quantile(0.75), "skewness": s.skew(), "kurtosis": s.kurtosis(),
        }.items():
            assert r[name] == pytest.approx(value, abs=1e-8), (c, name)


def test_small_samples(make):
    df = make([(1.0, 1.0), (2.0, None), (4.0, 2.0)], "x double, y double")
    rows = stats.descriptive_stats(df).collect()
    assert [r["column"] for r in rows] == ["x"]
    assert rows[0]["kurtosis"] is None
    assert stats.normality_test(df).count() == 0


def test_component_statistics_equal_published_values(make):
    def moments(values):
        x = np.array(values, float)
        d = x - x.mean()
        m2 = (d**2).mean()
        return float(len(x)), float((d**3).mean() / m2**1.5), float((d**4).mean() / m2**2 - 3)

    rows = [moments(range(1, 9)), moments([2, 8, 0, 4, 1, 9, 9, 0]), moments(range(20))]
    df = make(rows, "n double, g1 double, g2 double").select(
        shape.skewness_z(F.col("n"), F.col("g1")).alias("s"), shape.kurtosis_z(F.col("n"), F.col("g2")).alias("k")
    )
    found = df.collect()
    assert found[0]["s"] == pytest.approx(1.0108048609177787)
    assert found[1]["s"] == pytest.approx(0.44626385374196975)
    assert found[2]["k"] == pytest.approx(-1.7058104152122062)


def test_distribution_types(make, frame):
    found = {r["column"]: r["distribution_type"] for r in stats.distribution_types(to_spark(make, frame)).collect()}
    assert found["a"] == "normal"
    assert found["b"] == "highly right-skewed"
    assert found["d"] == "approximately symmetric"


def test_correlation_with_gaps_equals_pandas(make, frame):
    expected = frame.corr()
    pairs = stats.correlation_pairs(to_spark(make, frame)).collect()
    assert {(r["col1"], r["col2"]) for r in pairs} == {
        (a, b) for i, a in enumerate("abce") for b in "abce"[i + 1 :]
    }
    for r in pairs:
        assert r["r"] == pytest.approx(expected.loc[r["col1"], r["col2"]], abs=1e-10)


def test_correlation_where_sums_lose_the_variance(make):
    """Next to its spread over all rows, ``a`` hardly varies where ``b`` has values; ``b`` and ``c`` never meet."""
    rows = [(float(i % 7) * 1e-6 + 5.0, float(i), None) for i in range(40)]
    rows += [(float(i) * 1e5, None, float(i)) for i in range(-20, 20)] + [(3.0, None, None)] * 5
    found = {(r["col1"], r["col2"]): r["r"] for r in stats.correlation_pairs(make(rows, "a double, b double, c double")).collect()}
    expected = pd.DataFrame(rows, columns=["a", "b", "c"]).astype(float).corr()
    assert set(found) == {("a", "b"), ("a", "c")}
    assert all(r == pytest.approx(expected.loc[a, b], abs=1e-6) for (a, b), r in found.items())
    constant = [(2.0, float(i)) for i in range(9)] + [(float(i), None) for i in range(9)]
    assert stats.correlation_pairs(make(constant, "a double, b double")).count() == 0


def test_correlation_sentences(make, frame):
    df = to_spark(make, frame)
    summary = stats.correlation_summary(df).first()
    assert summary["strong_count"] == 1
    assert summary["summary"].startswith("1 strong correlation(s) found. Strongest: a & e (r=0.99")
    assert stats.strongest_pair(df).first()["col2"] == "e"
    assert "Insufficient" in stats.correlation_summary(df.select("a")).first()["summary"]


def test_entropy_and_variance(make):
    df = make([("x" if i % 4 else "y", float(i)) for i in range(100)], "s string, n double")
    found = {r["feature"]: r["score"] for r in importance.variance_entropy_rank(df).collect()}
    assert found["s"] == pytest.approx(0.8113, abs=1e-4)
    n = pd.Series(range(100), dtype=float)
    assert found["n"] == pytest.approx(n.var() / n.mean() ** 2, abs=1e-6)


def test_information_ranks_the_signal_first(make):
    rng = np.random.default_rng(5)
    rows = [(int(v > 0), float(v), float(w), "p" if v > 0.5 else "q") for v, w in rng.normal(size=(500, 2))]
    df = make(rows, "y int, signal double, noise double, word string")
    method, ranked = importance.target_information(df, "y")
    assert method == "mutual_info_classif"
    order = [r["feature"] for r in ranked.collect()]
    assert order == ["signal", "word", "noise"]
    assert importance.target_information(df, "signal")[0] == "mutual_info_regression"
    assert importance.mutual_information(df.limit(19), "y") is None
    assert importance.feature_importance(df.limit(19), "y").first()["method"] == "variance_entropy"
    assert importance.mutual_information(df.select("y"), "y") is None


def test_information_equals_brute_force(make):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 3, 300)
    x = [f"{v}{'long ' * 20 if v else ''}" for v in (y + rng.integers(0, 2, 300))]
    df = make(list(zip([int(v) for v in y], x)), "y int, x string")
    joint = pd.crosstab(pd.Series(x), pd.Series(y)).to_numpy() / 300
    px, py = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True)
    cell = joint > 0
    expected = (joint[cell] * np.log(joint[cell] / (px @ py)[cell])).sum()
    assert importance.mutual_information(df, "y", digits=9).first()["score"] == pytest.approx(expected, abs=1e-8)


def test_clusters(make):
    rng = np.random.default_rng(1)
    spots = [(0, 0), (50, 0), (0, 50)]
    rows = [(i, float(spots[i % 3][0] + rng.normal()), float(spots[i % 3][1] + rng.normal())) for i in range(150)]
    df = make([(str(i), x, y) for i, x, y in rows + [(999, None, 1.0)]], "id string, x double, y double")
    found = cluster.kmeans_search(df)
    assert found.best_k == 3 and [k for k, *_ in found.scores] == list(range(2, 9))
    sizes = {r["cluster"]: r["size"] for r in found.sizes().collect()}
    assert sorted(sizes.values()) == [50, 50, 50]
    labels = found.labelled.toPandas()
    assert len(labels) == 150 and labels.groupby(labels["id"].astype(int) % 3)["cluster"].nunique().max() == 1
    centers = {(r["cluster"], r["column"]): r["center"] for r in found.centers().collect()}
    means = labels.groupby("cluster")[["x", "y"]].mean()
    for (k, c), value in centers.items():
        assert value == pytest.approx(means.loc[k, c], abs=1e-6)
    grid = charts.chart_clusters(found, 10).collect()
    assert sum(r["cnt"] for r in grid) == 150 and {r["cluster"] for r in grid} == {f"Cluster {k}" for k in range(3)}
    assert cluster.kmeans_search(df.limit(20)) is None
    assert cluster.kmeans_search(df.select("x")) is None


def test_clusters_do_not_depend_on_partitions(make):
    rng = np.random.default_rng(5)
    values = np.vstack([rng.normal(c, 1.5, (60, 3)) for c in (0, 4, 9)])
    df = make([tuple(map(float, v)) for v in values], "a double, b double, c double")
    found = [cluster.kmeans_search(df.repartition(n), max_k=5) for n in (1, 7)]
    first, again = (
        (f.best_k, [(k, round(s, 9), round(e, 9), round(f.inertia[k], 6)) for k, s, e in f.scores], f.points.tolist(), sorted(map(tuple, f.labelled.collect())))
        for f in found
    )
    assert first == again
    # The centres of every k are a fixed point, and the scores are those of the labels.
    x = (values - values.mean(0)) / values.std(0, ddof=1)
    labels = ((x[:, None] - found[0].points[None]) ** 2).sum(2).argmin(1)
    for k, point in enumerate(found[0].points):
        assert x[labels == k].mean(0) == pytest.approx(point, abs=0.02)
    means = np.array([[np.sqrt(((x[labels == k] - v) ** 2).sum(1)).mean() for k in range(found[0].best_k)] for v in x])
    n = np.bincount(labels)
    own = means[np.arange(180), labels] * n[labels] / (n[labels] - 1)
    means[np.arange(180), labels] = np.inf
    other = means.min(1)
    exact, error = ((other - own) / np.maximum(own, other)).mean(), dict((k, e) for k, _, e in found[0].scores)
    assert abs(found[0].silhouette - exact) <= error[found[0].best_k] + 1e-4 < 0.1


def test_infinite_values_have_bins_of_their_own(make):
    df = make([(float(i),) for i in range(60)] + [(float("inf"),), (float("-inf"),), (float("-inf"),)], "x double")
    rows = {r["bin"]: r["cnt"] for r in charts.hist_grid(df, ["x"]).collect()}
    assert [rows[b] for b in range(30)] == [2] * 30 and rows[-1] == 2 and rows[30] == 1
    grid = charts.scatter_points(df.withColumn("y", F.lit(1)), "x", "y").collect()
    assert sum(r["cnt"] for r in grid) == 60


def test_histogram_bins(make, frame):
    df = to_spark(make, frame)
    rows = charts.hist_grid(df, ["a", "b", "d"]).collect()
    for c in ("a", "b"):
        values = frame[c].dropna()
        expected = np.histogram(values, bins=30)[0]
        assert [r["cnt"] for r in sorted(rows, key=lambda r: r["bin"]) if r["column"] == c] == list(expected)
    assert [(r["bin"], r["cnt"]) for r in rows if r["column"] == "d"] == [(0, 400)]


def test_filling(make):
    rows = [(1, 1.0, " a ", None, None), (2, float("nan"), "b", True, None), (None, 4.0, None, True, None)]
    df = make(rows + [(None, None, None, None, None)], "i int, x double, s string, f boolean, t string")
    found = [tuple(r) for r in clean_table(df).orderBy("x", "i").collect()]
    assert found == [
        (1.0, 1.0, "a", True, "Unknown"), (2.0, 2.5, "b", True, "Unknown"), (1.5, 4.0, "a", True, "Unknown"),
    ]
    assert fill_medians(make([(None,), (None,)], "x double")).first()[0] is None


def test_mode_ties_of_long_texts(make):
    long = ["z" * 100 + "b", "z" * 100 + "a", "short", None]
    assert fill_modes(make([(v,) for v in long], "s string")).filter("s = 'short'").count() == 2
    twice = make([(v,) for v in long[:2] * 2 + ["short", None]], "s string")
    assert fill_modes(twice).filter(F.col("s") == long[1]).count() == 3


def test_numbers_of_a_target_are_not_counted_by_value(make, monkeypatch):
    """Twenty values make classes, one more does not; tasks send a few values each, and zero is one value with either sign."""
    rows = [(float(i % 20) * (-1.0 if i % 40 == 0 else 1.0), i % 3) for i in range(400)]
    few = make(rows, "y double, x int")
    many = make([*rows, (99.5, 1)], "y double, x int").repartition(5)
    assert importance._target_facts(few, "y") == (400, 20)
    assert importance._target_facts(many, "y")[0] == 401 and importance._target_facts(many, "y")[1] > 20
    monkeypatch.setattr(importance, "class_summary", None)
    assert importance.target_information(few, "y")[0] == "mutual_info_classif"
    assert importance.target_information(many, "y")[0] == "mutual_info_regression"
    assert importance.neighbour_information(many, "y")[0] == "mutual_info_regression"
