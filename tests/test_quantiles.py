"""Exact quantiles and median gaps against NumPy."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.plans.gaps import median_gap
from tablescope.plans.quantiles import exact_quantiles, order_statistics

POINTS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(7)
    n = 6000
    return {
        "normal": rng.normal(size=n),
        "heavy": np.exp(3 * rng.normal(size=n)),
        "few": rng.integers(0, 4, n).astype(float),
        "two": np.repeat([0.0, 1.0], n // 2),
        "hot": np.where(np.arange(n) % 3 == 0, 5.0, rng.normal(size=n)),
        "constant": np.full(n, 2.5),
        "far": np.concatenate([rng.normal(size=n - 2), [-1e300, 1e300]]),
    }


def gappy(values, i):
    return None if i % 11 == 0 else float(values[i])


@pytest.mark.parametrize("bracket_rows", [20, 10**6])
def test_quantiles_equal_numpy(make, numbers, bracket_rows):
    names = list(numbers)
    rows = [tuple(gappy(numbers[c], i) for c in names) for i in range(6000)]
    df = make(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    found = exact_quantiles(df, names, POINTS, bracket_rows=bracket_rows)
    for row in found.collect():
        values = [v for i in range(6000) if (v := gappy(numbers[row["column"]], i)) is not None]
        assert list(row)[1:] == pytest.approx(np.quantile(values, POINTS), rel=1e-12)


def test_ranks_without_sorting(spark):
    df = spark.range(100_000).select((F.col("id") * 7 % 100_003).cast("double").alias("x"))
    wanted = [("x", r) for r in (0, 1, 50_000, 99_998, 99_999)]
    expected = sorted(i * 7 % 100_003 for i in range(100_000))
    found = order_statistics(df, wanted, {"x": 100_000}, bracket_rows=50)
    assert found == {("x", r): float(expected[r]) for _, r in wanted}


def test_jobs_do_not_grow_with_the_ranks(spark):
    df = spark.range(50_000).select(F.rand(1).alias("x"), F.rand(2).alias("y"))
    tracker = spark.sparkContext.statusTracker()

    def jobs(points):
        name = f"ranks-{len(points)}"
        spark.sparkContext.setJobGroup(name, name)
        exact_quantiles(df, ["x", "y"], points, bracket_rows=100)
        spark.sparkContext.setJobGroup("", "")
        return len(tracker.getJobIdsForGroup(name))

    assert jobs([0.5, 0.7]) == jobs([i / 100 for i in range(1, 100)]) <= 12


def test_empty_column_gives_no_row(make):
    df = make([(1.0, None), (3.0, None)], "a double, b double")
    for limit in (0, 100):
        rows = exact_quantiles(df, ["a", "b"], [0.5], bracket_rows=limit).collect()
        assert [tuple(r) for r in rows] == [("a", 2.0)]


@pytest.mark.parametrize("times_per_bucket", [10**6, 37])
@pytest.mark.parametrize("repeats", [1, 2, 4])
def test_median_gap(make, times_per_bucket, repeats):
    rng = np.random.default_rng(repeats)
    start = datetime(2024, 1, 1)
    moments = sorted(start + timedelta(microseconds=int(x)) for x in rng.integers(0, 10**11, 800)) * repeats
    if repeats == 2:
        moments += [start + timedelta(days=400)]
    df = make([(m,) for m in moments], "t timestamp_ntz").repartition(3)
    gaps = np.diff(np.array(sorted(moments), dtype="datetime64[us]")).astype("int64")
    row = median_gap(df, "t", times_per_bucket, bracket_rows=20).first()
    assert (row["n_records"], row["median_gap_us"]) == (len(moments), float(np.median(gaps)))


def test_median_gap_needs_three_records(make):
    row = median_gap(make([(datetime(2024, 1, 1),), (datetime(2024, 1, 2),), (None,)], "t timestamp_ntz"), "t").first()
    assert tuple(row) == (2, None)
