"""Boundaries of the schema rules on small tables."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope.functions.grades import frequency_label
from tablescope.operators import schema
from tablescope.operators.names import name_map, normalized_names
from tablescope.plans import passes


def types_of(df):
    return {r["column"]: r["semantic_type"] for r in schema.semantic_types(df).collect()}


def test_semantic_type_limits(make):
    rows = [
        (
            i % 2, i % 3, i % 20, i % 21, ["yes", "no"][i % 2], ["up", "down"][i % 2], f"k{i}", f"v{i % 30}",
            f"w{i % 31}", f"{'long ' * 12}{i % 40}", f"2024-01-{i % 28 + 1:02d}", f"{i}", None, i % 2 == 0, [1.0, 2.0],
        )
        for i in range(60)
    ]
    df = make(
        rows,
        "two int, three int, twenty int, more int, yes_no string, up_down string, key string, thirty string, "
        "thirty_one string, prose string, day string, digits string, nothing double, flag boolean, vector array<double>",
    )
    assert types_of(df) == {
        "two": "boolean",
        "three": "categorical",
        "twenty": "categorical",
        "more": "numeric",
        "yes_no": "boolean",
        "up_down": "categorical",
        "key": "identifier",
        "thirty": "categorical",
        "thirty_one": "categorical",
        "prose": "text",
        "day": "datetime",
        "digits": "identifier",
        "nothing": "boolean",
        "flag": "boolean",
        "vector": "unknown",
    }


def test_small_tables_have_no_categorical_numbers(make):
    assert types_of(make([(i % 5,) for i in range(50)], "x int")) == {"x": "numeric"}
    assert types_of(make([(i % 5,) for i in range(51)], "x int")) == {"x": "categorical"}
    assert types_of(make([(f"a{i}",) for i in range(10)], "x string")) == {"x": "categorical"}
    assert types_of(make([(f"a{i}",) for i in range(11)], "x string")) == {"x": "identifier"}


def test_datetime_share_is_eighty_percent(make):
    for good, expected in ((8, True), (7, False)):
        rows = [("2024-03-01 10:00:00" if i < good else "soon",) for i in range(10)]
        assert schema.datetime_parse_rates(make(rows, "x string")).first()["is_datetime"] is expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2024-02-29", datetime(2024, 2, 29)),
        ("2024/2/9", datetime(2024, 2, 9)),
        ("02/13/2024", datetime(2024, 2, 13)),
        ("13/02/2024 08:30", datetime(2024, 2, 13, 8, 30)),
        ("2024-02-01T10:11:12.5Z", datetime(2024, 2, 1, 10, 11, 12, 500000)),
        ("5 Jan 2024", datetime(2024, 1, 5)),
        ("Jan 5, 2024", datetime(2024, 1, 5)),
        ("March 5, 2024", datetime(2024, 3, 5)),
        ("2023-02-29", None),
        ("2024", None),
        ("12", None),
        ("tomorrow", None),
    ],
)
def test_parse_timestamp(make, text, expected):
    from tablescope.functions.text import parse_timestamp

    assert make([(text,)], "x string").select(parse_timestamp(F.col("x"))).first()[0] == expected


def test_mixed_share_is_open_interval(make):
    rows = [("1" if i < 3 else "a", "1" if i < 4 else "a", "1" if i < 9 else "a") for i in range(10)]
    found = schema.mixed_columns(make(rows, "at string, above string, high string")).collect()
    assert [(r["column"], r["numeric_parseable_pct"]) for r in found] == [("above", 40.0), ("high", 90.0)]


def test_numeric_text(make):
    from tablescope.functions.text import looks_numeric

    good = ["1", "-2.5", " 3 ", "+.5", "1e9", "4.", "inf", "-Infinity"]
    bad = ["", "nan", "12d", "1f", "0x10", "1_0", "1,000", ".", "e5"]
    df = make([(t,) for t in good + bad], "x string").select("x", looks_numeric(F.col("x")).alias("ok"))
    assert {r["x"]: r["ok"] for r in df.collect()} == {**dict.fromkeys(good, True), **dict.fromkeys(bad, False)}


def test_target_scores(make):
    rows = [(i % 2, int(i % 10 == 0), i % 10, i % 11, i) for i in range(60)]
    df = make(rows, "plain int, label int, ten int, eleven int, class_id int")
    found = {r["column"]: (r["score"], r["reasons"]) for r in schema.target_candidates(df).collect()}
    assert found == {
        "label": (
            6,
            "Name contains 'label'; Binary column (2 unique values); Imbalanced (10.0% minority class)",
        ),
        "class_id": (3, "Name contains 'class'"),
        "plain": (2, "Binary column (2 unique values)"),
    }
    assert schema.name_keyword("l_quantity") == "y"
    assert schema.name_keyword("l_quantity", match="token") is None
    assert schema.name_keyword("is_y", match="token") == "y"


def test_hash_keys_span_all_of_64_bits(make):
    df = make([(-(2**63),), (2**63 - 1,), (5,)], "h bigint")
    found = schema.primary_keys(df).first()
    assert not found["is_sequential"] and found["confidence"] == "high"


def test_primary_keys(make):
    rows = [(i, i * 2, f"id{i:03d}", f"n{i}", None if i == 3 else i, i % 9) for i in range(20)]
    df = make(rows, "dense int, even int, fixed string, loose string, gap int, repeat int")
    found = {r["column"]: (r["is_sequential"], r["confidence"]) for r in schema.primary_keys(df).collect()}
    assert found == {
        "dense": (True, "very_high"),
        "even": (False, "high"),
        "fixed": (False, "very_high"),
        "loose": (False, "high"),
    }
    assert schema.primary_keys(df.limit(0)).count() == 0


def test_best_time_column(make):
    day = datetime(2024, 1, 1)
    rows = [(day + timedelta(days=i % 3), day + timedelta(days=i)) for i in range(9)]
    assert schema.best_time_column(make(rows, "a timestamp_ntz, b timestamp_ntz")) == "b"
    assert schema.best_time_column(make(rows, "updated_at timestamp_ntz, created timestamp_ntz")) == "updated_at"
    assert schema.best_time_column(make([(1,)], "date int")) is None


@pytest.mark.parametrize(
    "hours,label",
    [
        (0, "sub-hourly"), (0.99, "sub-hourly"), (1, "hourly"), (1.5, "hourly"), (1.6, "intra-day"), (23.9, "intra-day"),
        (24, "daily"), (47.9, "daily"), (48, "~2-day intervals"), (24 * 6, "weekly"), (24 * 8, "weekly"),
        (24 * 9, "~9-day intervals"), (24 * 13, "bi-weekly"), (24 * 16, "bi-weekly"), (24 * 27, "monthly"),
        (24 * 33, "monthly"), (24 * 85, "quarterly"), (24 * 95, "quarterly"), (24 * 360, "yearly"),
        (24 * 370, "yearly"), (24 * 371, "~371-day intervals"), (None, None),
    ],
)
def test_frequency_labels(make, hours, label):
    df = make([(None if hours is None else hours * 3.6e9,)], "us double")
    assert df.select(frequency_label(F.col("us"))).first()[0] == label


def test_names():
    assert normalized_names([" Order-Key ", "order.key", "Price (USD)", "a//b", "[x]", "order_key_1", "order key"]) == [
        "order_key", "order_key_1", "price_usd", "a_b", "x", "order_key_1_1", "order_key_2",
    ]


@given(st.lists(st.text(alphabet="aB _-.1[]", max_size=5), max_size=12))
def test_names_are_unique_and_settled(names):
    once = normalized_names(names)
    assert len(set(once)) == len(once) == len(names)
    assert normalized_names(once) == once or "" in once


def test_names_stay_unique(make):
    names = normalized_names(["x", "x_1", "X", "x", "x_1"])
    assert len(set(names)) == len(names)
    rows = name_map(make([(1, 2)], "`A b` int, `a-b` int")).collect()
    assert [tuple(r) for r in rows] == [("A b", "a_b", 0), ("a-b", "a_b_1", 1)]


def test_long_texts_are_compared_whole(make):
    stem = "x" * 300
    rows = [(stem + "a",)] * 3 + [(stem + "b",)] * 2 + [(f" {stem}c ",), ("short",), (None,)]
    df = make(rows, "t string").repartition(3)
    row = passes.column_facts(df).first()
    assert (row["n_unique"], row["n_null"], row["majority"], row["majority_cnt"]) == (4, 1, stem + "a", 3)
    assert (row["n_edge_space"], row["max_len"], row["min_len"]) == (1, 303, 5)


def test_reports_do_not_depend_on_partitioning(spark):
    from conftest import SF
    from query_set.views import table

    df = table(spark, SF, "orders_dirty")
    one, seven = df.coalesce(1), df.repartition(7)
    for report in (schema.column_profile, schema.target_candidates, schema.primary_keys):
        assert report(one).collect() == report(seven).collect()


def test_every_kind_of_white_space_is_trimmed(make):
    from tablescope.functions.text import has_edge_space, trimmed

    spaces = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    rows = [(f"{s}a b{s}",) for s in spaces] + [(chr(0x200B) + "a",), ("a" + chr(0x200B),)]
    found = make(rows, "x string").select("x", trimmed(F.col("x")).alias("t"), has_edge_space(F.col("x")).alias("e"))
    for r in found.collect():
        assert r["t"] == r["x"].strip()
        assert r["e"] == (r["x"] != r["x"].strip())
