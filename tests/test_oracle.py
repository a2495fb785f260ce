"""Every query with SQL against DuckDB, and every query without SQL for its shape."""

import os

import duckdb
import pytest

from conftest import SF
from query_set.oracle import oracle_sql
from query_set.spark_queries import queries

QUERIES, ORACLE = queries(), oracle_sql()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {
        "kmeans_k_scores", "kmeans_sizes", "kmeans_centers", "kmeans_labels", "chart_clusters", "chart_silhouette",
        "report_context",
    }


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = df.collect()
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    types = {d[0]: str(d[1]) for d in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    order = sorted(columns)
    expected = sorted(tuple(plain(row[columns.index(c)]) for c in order) for row in result.fetchall())
    assert sorted(tuple(plain(row[c]) for c in order) for row in found) == expected


@pytest.mark.parametrize("name", ["report_context"])
def test_query_without_sql_repeats(spark, name):
    first, again = QUERIES[name](spark, SF).collect(), QUERIES[name](spark, SF).collect()
    assert first and first == again
