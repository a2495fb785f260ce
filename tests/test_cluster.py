"""Clustering against plain code: squared errors of all starts, and silhouettes from all pairs."""

import numpy as np
import pytest

from conftest import SF
from query_set.views import table
from tablescope.operators import clean, cluster


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(11)
    spots = rng.normal(0, 8, (9, 4))
    return np.vstack([rng.normal(c, rng.uniform(0.3, 3), (rng.integers(5, 120), 4)) for c in spots] + [[[200.0, 0, 0, 0]]])


def frame(spark, values):
    names = [f"c{i}" for i in range(values.shape[1])]
    return spark.createDataFrame([tuple(map(float, v)) for v in values], names)


def standard(values, found):
    return (values - np.array(found.mean)) / np.array(found.std)


def plain_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    scores = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) - {c})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


@pytest.mark.parametrize("cells", [4, 64, 100_000])
def test_silhouette_within_its_error(spark, values, cells):
    found = cluster.kmeans_search(frame(spark, values).repartition(3), max_k=5, starts=2, cells=cells)
    x = standard(values, found)
    for k, score, error in found.scores:
        if k == found.best_k:
            labels = ((x[:, None] - found.points) ** 2).sum(axis=2).argmin(axis=1)
            exact = plain_silhouette(x, labels)
            assert abs(score - exact) <= error + 1e-9
            if cells > len(x):
                assert error < 1e-6
    rows = found.k_scores().collect()
    assert [r["k"] for r in rows] == [2, 3, 4, 5] and sum(r["is_best"] for r in rows) == 1


def test_more_starts_never_do_worse(spark, values):
    df = frame(spark, values)
    split, seeded = (cluster.kmeans_search(df, starts=n).inertia for n in (0, 10))
    assert all(seeded[k] <= split[k] * (1 + 1e-9) for k in split)
    assert any(seeded[k] < split[k] * 0.99 for k in split)
    x = standard(values, cluster.kmeans_search(df, max_k=2, starts=1))
    rng = np.random.default_rng(0)
    for k in (3, 6, 8):  # no worse than a plain search with as many starts
        best = np.inf
        for _ in range(10):
            c = x[rng.choice(len(x), k, replace=False)]
            for _ in range(100):
                near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
                c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
            best = min(best, ((x - c[near]) ** 2).sum())
        assert seeded[k] <= best * 1.02


def test_seeds_do_not_depend_on_partitions(spark, values):
    df = frame(spark, np.vstack([values, values[:50]]))
    one, many = (cluster._draw(cluster._packed(df.repartition(n)), [np.zeros((0, 4)), values[:3]], 1, 8) for n in (1, 6))
    assert [a.tolist() for a in one] == [a.tolist() for a in many]
    assert [len({tuple(r) for r in a}) for a in one] == [8, 8]
    same = frame(spark, np.ones((40, 2)))
    assert cluster.kmeans_search(same) is None
    two = frame(spark, np.repeat([[0.0, 1.0], [5.0, 2.0]], 20, axis=0))
    found = cluster.kmeans_search(two)
    assert found.best_k == 2 and found.scores[0][1:] == pytest.approx((1.0, 0.0), abs=1e-6)


def test_supplied_table(spark):
    df = clean.clean_table(table(spark, SF, "orders_dirty"))
    split, seeded = (cluster.kmeans_search(df, starts=n) for n in (0, 10))
    assert all(seeded.inertia[k] <= split.inertia[k] * (1 + 1e-9) for k in split.inertia)


def test_table_in_one_partition_is_dealt_over_the_cores(spark, values, monkeypatch):
    monkeypatch.setattr(cluster, "PACK", 64)
    monkeypatch.setattr(cluster, "PARTS", (64, 1 << 22), raising=False)
    seen, silhouettes = [], cluster._silhouettes

    def watched(points, *rest):
        seen.extend(points.mapInArrow(lambda batches: (b.select(["n"]) for b in batches), "n long").rdd.glom().map(len).collect())
        return silhouettes(points, *rest)

    df = frame(spark, values).coalesce(1)
    one = cluster.kmeans_search(df, max_k=4, starts=2).k_scores().collect()
    monkeypatch.setattr(cluster, "_silhouettes", watched)
    assert cluster.kmeans_search(df, max_k=4, starts=2).k_scores().collect() == one
    assert sum(n > 0 for n in seen) > 1


def test_sums_of_tables_of_many_sizes(spark):
    rng = np.random.default_rng(5)
    # Whole numbers have exact distances, and many rows lie between two centres.
    x = rng.integers(-4, 5, (700, 3)).astype(float)
    tables = {k: rng.integers(-4, 5, (n, 3)).astype(float) for k, n in (("a", 2), ("b", 7), ("c", 1), ("d", 4))}
    tables["d"][3] = tables["d"][0]
    for key, (table, error) in cluster._sums(cluster._packed(frame(spark, x).repartition(3)), tables).items():
        d = ((x[:, None] - tables[key]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        assert table.tolist() == [[(near == i).sum(), *x[near == i].sum(axis=0)] for i in range(len(tables[key]))]
        assert error == d.min(axis=1).sum()
