"""Quality rules at their limits, duplicates and formats against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablescope.functions import grades
from tablescope.operators import quality
from tablescope.plans.duplicates import duplicated_rows
from tablescope.plans.passes import class_summary


@pytest.mark.parametrize(
    "scale,cases",
    [
        (
            grades.missing_severity,
            {0.0: "none", 0.01: "low", 4.99: "low", 5.0: "moderate", 15.0: "high", 40.0: "critical"},
        ),
        (
            grades.outlier_severity,
            {0.0: "none", 1.99: "low", 2.0: "moderate", 5.0: "high", 14.99: "high", 15.0: "extreme"},
        ),
        (
            grades.imbalance_severity,
            {1.0: "balanced", 1.5: "mild", 3.0: "moderate", 10.0: "severe", 50.0: "extreme"},
        ),
        (
            grades.correlation_strength,
            {-0.95: "very strong", 0.9: "very strong", 0.7: "strong", 0.5: "moderate", -0.3: "weak", 0.29: "negligible"},
        ),
        (grades.quality_grade, {90.0: "A", 89.9: "B", 75.0: "B", 60.0: "C", 40.0: "D", 39.9: "F"}),
        (grades.gauge_band, {39.9: "0-40", 40.0: "40-60", 60.0: "60-75", 75.0: "75-100", 100.0: "75-100"}),
    ],
)
def test_scales(make, scale, cases):
    df = make([(v,) for v in cases], "v double").select("v", scale(F.col("v")).alias("word"))
    assert {r["v"]: r["word"] for r in df.collect()} == cases


@pytest.mark.parametrize("broadcast_hashes", [0, 1000])
def test_duplicates(make, broadcast_hashes):
    rows = [(i % 7, "a" if i % 2 else None, float("nan") if i % 3 == 0 else 1.0) for i in range(200)]
    rows += [(None, "1", None), (1, None, None)]
    same = [(a, b, None if c != c else c) if c is not None else (a, b, c) for a, b, c in rows]
    df = make(rows, "a int, b string, c double").repartition(5)
    assert duplicated_rows(df, broadcast_hashes) == len(same) - len(set(same))


def test_no_duplicates_and_hot_group(make, spark):
    assert duplicated_rows(spark.range(5000)) == 0
    hot = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("x"))
    assert duplicated_rows(hot) == 2999
    assert duplicated_rows(make([], "a int, b string")) == 0


@pytest.mark.parametrize("copies,word", [(0, "No exact"), (1, "Minor"), (5, "Moderate"), (100, "Heavy")])
def test_duplicate_advice(make, copies, word):
    df = make([(i,) for i in range(200)] + [(0,)] * copies, "x int")
    assert quality.duplicate_rows(df).first()["recommendation"].startswith(word)


def test_null_counts_as_a_value_in_repeats(make):
    df = make([("a", 1), ("a", 1), (None, 1), (None, 1), ("b", 1)], "s string, n int")
    assert [tuple(r) for r in quality.duplicate_subsets(df).collect()] == [("s", 2, 40.0)]


def test_every_text_column_is_searched_for_repeats(make):
    wide = make([tuple("a" for _ in range(16))] * 2, ", ".join(f"c{i} string" for i in range(16)))
    assert quality.duplicate_subsets(wide).count() == 16
    assert quality.duplicate_subsets(wide, top=5).count() == 5


def test_maps_and_variants_are_compared_by_content(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
        (map('a', 1, 'b', 2), parse_json('{"x": 1, "y": [2]}'), array(map(1, 'u'))),
        (map('b', 2, 'a', 1), parse_json('{"y": [2], "x": 1}'), array(map(1, 'u'))),
        (map('a', 1), parse_json('{"x": 1, "y": [2]}'), array(map(1, 'u'))),
        (map('a', 1), NULL, NULL), (map('a', 1), NULL, NULL) AS t(m, v, n)"""
    )
    assert duplicated_rows(df) == 2
    assert quality.duplicate_rows(df).first()["exact_duplicates"] == 2


def test_numeric_ties_are_ordered_as_numbers(make):
    df = make([(9, "x"), (10, "x"), (9, "y"), (10, "y")], "n int, s string")
    found = {r["column"]: r["majority"] for r in class_summary(df, ["n", "s"]).collect()}
    assert found == {"n": "9", "s": "x"}


def test_formats(make):
    values = ["New York", "new york", " NEW YORK", "x", "x", "", " \t ", " pad", None, "line\n"]
    df = make([(v, "ok") for v in values], "s string, t string")
    assert [tuple(r) for r in quality.format_whitespace(df).collect()] == [("s", 4)]
    assert [tuple(r) for r in quality.format_empty_strings(df).collect()] == [("s", 2)]
    found = quality.format_case_variants(df).collect()
    assert {(r["canonical"], r["variant"], r["cnt"], r["total"]) for r in found} == {
        ("new york", "New York", 1, 3), ("new york", "new york", 1, 3), ("new york", " NEW YORK", 1, 3),
        ("", "", 1, 2), ("", " \t ", 1, 2),
    }
    assert [tuple(r) for r in quality.format_issues(df).collect()] == [
        ("s", 0, 3, "whitespace, mixed_case, empty_strings")
    ]


def test_case_variants_keep_the_five_largest_groups(make):
    rows = [(f"{w}{k}",) for k in range(8) for w in ["A"] * (k + 1) + ["a"]]
    found = quality.format_case_variants(make(rows, "s string")).collect()
    assert {r["canonical"] for r in found} == {f"a{k}" for k in range(3, 8)}


def test_long_case_variants(make):
    body = "Word " * 50
    df = make([(body,), (body.upper(),), (body.upper(),), ("other " * 30,)], "s string")
    found = quality.format_case_variants(df).collect()
    assert Counter({r["variant"]: r["cnt"] for r in found}) == Counter({body: 1, body.upper(): 2})


def test_outlier_limits(make):
    nine = make([(float(i),) for i in range(9)], "x double")
    assert quality.iqr_outliers(nine).count() == 0
    flat = make([(1.0,)] * 20 + [(99.0,)], "x double")
    assert quality.iqr_outliers(flat).count() == 0
    edge = [float(i) for i in range(1, 10)]  # quartiles 3 and 7 with the two ends below
    row = quality.iqr_outliers(make([(v,) for v in edge + [5.0, -3.0, 13.0, 13.1]], "x double")).first()
    assert row["outlier_count"] == sum(v < row["lower_bound"] or v > row["upper_bound"] for v in edge + [-3.0, 13.0, 13.1])


def test_outlier_samples_are_the_extremes(make):
    df = make([(float(i % 10),) for i in range(100)] + [(500.0 + i,) for i in range(8)], "x double")
    found = [r["value"] for r in quality.outlier_samples(df).orderBy("rank").collect()]
    assert found == [507.0, 506.0, 505.0, 504.0, 503.0]


def test_missing_sentences(make):
    full = make([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert "fully complete" in quality.missing_summary(full).first()["pattern_summary"]
    some = make([(1, None, 3, None), (1, None, 3, 4)], "a int, b int, c int, d int")
    row = quality.missing_summary(some).first()
    assert row["pattern_summary"] == "Missing values concentrated in 2 column(s): b, d."
    assert (row["total_missing"], row["rows_with_any_missing"], row["rows_complete"]) == (3, 2, 0)
    many = make([(None, None, None, None), (1, 1, 1, 1)], "a int, b int, c int, d int")
    assert "spread across 4 columns" in quality.missing_summary(many).first()["pattern_summary"]


def test_imbalance(make):
    rows = [("a" if i < 90 else "b", i % 16, i % 15, 1) for i in range(100)]
    df = make(rows, "status string, sixteen int, fifteen int, one int")
    found = {r["column"]: r for r in quality.class_imbalance(df).collect()}
    assert set(found) == {"status", "fifteen"}
    status = found["status"]
    assert (status["majority_class"], status["minority_class"], status["imbalance_ratio"]) == ("a", "b", 9.0)
    assert status["is_target_column"] and status["severity"] == "moderate"
    assert status["recommendation"].startswith("Target column 'status' has moderate imbalance.")


def test_clean_table_scores_full_marks(make):
    df = make([(i, f"v{i}") for i in range(30)], "n int, s string")
    assert tuple(quality.quality_score(df).first()) == (25.0, 25.0, 25.0, 25.0, 100.0, "A")
