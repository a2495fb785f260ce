"""Keys in row order, with swaps inside and exactly between range partitions."""

import pytest

from tablescope.operators.schema import primary_keys
from tablescope.plans.order import rising_columns


def keyed(make, values, keys=None):
    keys = keys or list(range(len(values)))
    return make([(k, v, -v) for k, v in zip(keys, values, strict=True)], "at long, id long, down long")


def test_a_swap_anywhere_is_seen(make):
    n, parts = 40, 8
    df = keyed(make, range(n))
    assert rising_columns(df.repartition(5), ["id", "down"], ["at"], parts) == {"id"}
    edges = df.repartitionByRange(parts, "at").selectExpr("spark_partition_id() AS p", "at").groupBy("p").agg({"at": "max"}).collect()
    last = sorted(r["max(at)"] for r in edges)
    assert len(last) == parts
    for at in [0, 1, n - 2, *last[:-1]]:
        values = list(range(n))
        values[at], values[at + 1] = values[at + 1], values[at]
        assert rising_columns(keyed(make, values).repartition(3), ["id"], ["at"], parts) == set()
    assert rising_columns(keyed(make, [0, 1, 1, 2]), ["id"], ["at"], 4) == set()


def test_equal_order_keys_stand_in_any_order(make):
    assert rising_columns(keyed(make, [3, 1, 2, 9, 8], [0, 0, 0, 1, 1]), ["id"], ["at"]) == {"id"}
    assert rising_columns(keyed(make, [3, 1, 8, 9, 2], [0, 0, 0, 1, 1]), ["id"], ["at"]) == set()
    assert rising_columns(keyed(make, [7, 5, 6], [None, 2, 3]), ["id"], ["at"]) == set()
    assert rising_columns(keyed(make, [4, 5, 6], [None, 2, 3]), ["id"], ["at"]) == {"id"}


def test_gaps_and_empty_tables(make):
    df = make([(1, 1), (2, None), (3, 3)], "at long, id long")
    assert rising_columns(df, ["id"], ["at"]) == set()
    assert rising_columns(df.limit(0), ["id"], ["at"]) == set()
    assert rising_columns(df, [], ["at"]) == set()


@pytest.mark.parametrize(("order_by", "sequential"), [(["at"], True), (["back"], False), (None, False)])
def test_primary_keys(make, order_by, sequential):
    df = make([(k, 10 * k, -k, f"x{k}") for k in range(12)], "at long, id long, back long, name string")
    found = {r["column"]: r for r in primary_keys(df, order_by=order_by).collect()}
    assert found["id"]["is_sequential"] == sequential
    assert found["id"]["confidence"] == ("very_high" if sequential else "high")
    assert not found["name"]["is_sequential"] and found["name"]["confidence"] == "high"
