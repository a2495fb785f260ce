"""The passes over a table that the reports share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions import text
from tablescope.plans.columns import (
    col,
    collected,
    families,
    flat_columns,
    integer_columns,
    local_rows,
    nan_to_null,
    numeric_columns,
    per_column,
    schema_rows,
    string_columns,
    unpivot_numbers,
)

_FREQUENCY_SCHEMA = "column string, value string, cnt bigint"

# Texts longer than this are exchanged as a digest of the whole text wherever only equality counts.
LONG_TEXT = 64
DIGEST_LENGTH = 64
_LONG_SCHEMA = (
    "struct<length:int,is_numeric:boolean,is_datetime:boolean,has_edge_space:boolean,is_empty:boolean>"
)

def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, cnt)`` of all non-null values.

    Columns of one type are unpivoted together and counted in that type; only the distinct values are turned into
    text. Counting combines on the map side, so a value that fills a third of the table costs one row per task.
    """
    columns = flat_columns(df) if columns is None else list(columns)
    if not columns:
        return local_rows(df.sparkSession, [], _FREQUENCY_SCHEMA)
    parts = []
    for family in families(df, columns):
        cells = df.select(*[col(c) for c in family]).unpivot([], [col(c) for c in family], "column", "value")
        counted = cells.filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("cnt"))
        parts.append(counted.select("column", F.col("value").cast("string").alias("value"), "cnt"))
    return reduce(DataFrame.unionByName, parts)


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, cnt, long)``: the value counts, with long texts under their digest.

    Equal texts have equal digests, so the counts are those of the whole texts, but only 64 characters of a long
    text are exchanged. What is asked about the text itself is tested before and travels along as ``long``, which
    is NULL for every value that is not a long text.
    """
    texts = [c for c in columns if c in set(string_columns(df))]
    others = [c for c in columns if c not in set(texts)]
    none = F.lit(None).cast(_LONG_SCHEMA)
    result = value_counts(df, others).withColumn("long", none)
    if not texts:
        return result
    cells = df.select(*[col(c) for c in texts]).unpivot([], [col(c) for c in texts], "column", "value")
    value = F.col("value")
    is_long = F.length(value) > LONG_TEXT
    measures = F.struct(
        F.length(value).alias("length"),
        text.looks_numeric(value).alias("is_numeric"),
        text.parse_timestamp(value).isNotNull().alias("is_datetime"),
        text.has_edge_space(value).alias("has_edge_space"),
        (text.trimmed(value) == "").alias("is_empty"),
    ).cast(_LONG_SCHEMA)
    keyed = cells.filter("value IS NOT NULL").select(
        "column", text_key(value).alias("value"), F.when(is_long, measures).otherwise(none).alias("long")
    )
    counted = keyed.groupBy("column", "value", "long").agg(F.count("*").alias("cnt"))
    return result.unionByName(counted) if others else counted


def text_key(value: Column) -> Column:
    """A text that stands for the whole text in a grouping: the text itself, or its digest if it is long."""
    return F.when(F.length(value) > LONG_TEXT, F.sha2(value, 256)).otherwise(value)


def _class_measures(numbers: Sequence[str] = ()) -> list[Column]:
    number = F.when(F.col("column").isin(list(numbers)), F.col("value").try_cast("double")) if numbers else F.lit(None)
    order = F.struct(-F.col("cnt"), number.cast("double"), F.col("value"))
    return [
        F.count("*").alias("n_unique"),
        F.sum("cnt").alias("n_nonnull"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
        F.min_by("value", order).alias("majority"),
        F.max("cnt").alias("majority_cnt"),
        F.max_by("value", order).alias("minority"),
        F.min("cnt").alias("minority_cnt"),
        F.sum(F.col("cnt") * F.log2(F.col("cnt").cast("double"))).alias("sum_c_log2_c"),
        F.count("long").alias("n_long"),
    ]


def class_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column that has values: distinct count, first and last class, and the entropy sum.

    The order of classes is count descending, then value ascending: ``majority`` is the first, ``minority`` the
    last, numbers in their own order. Long texts of equal count are ordered by their digest. With exactly two distinct values, ``value_min`` and
    ``value_max`` are the whole value set.
    """
    return _with_texts(df, key_counts(df, columns).groupBy("column").agg(*_class_measures(numeric_columns(df))))


def _with_texts(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Digests of long texts put back into texts: at most four per column, found in one pass over those columns."""
    summary = collected(summary)
    shown = ["value_min", "value_max", "majority", "minority"]
    rows = [r.asDict() for r in summary.collect()]
    wanted = {r["column"]: {r[c] for c in shown if len(r[c]) == DIGEST_LENGTH} for r in rows if r["n_long"]}
    wanted = {c: digests for c, digests in wanted.items() if digests}
    if not wanted:
        return summary
    cells = df.select(*[col(c) for c in wanted]).unpivot([], [col(c) for c in wanted], "column", "value")
    digests = sorted(set().union(*wanted.values()))
    long = cells.filter(F.length("value") > LONG_TEXT).withColumn("digest", F.sha2("value", 256))
    found = long.filter(F.col("digest").isin(digests)).groupBy("column", "digest").agg(F.min("value").alias("value"))
    texts = {(r["column"], r["digest"]): r["value"] for r in found.collect()}
    for r in rows:
        for c in shown:
            r[c] = texts.get((r["column"], r[c]), r[c])
    return local_rows(df.sparkSession, [[r[c] for c in summary.columns] for r in rows], summary.schema)


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column: schema, counts, text measures and class summary. The base of all schema reports.

    Everything but the row count comes out of the value counts, so patterns are matched once per distinct value
    and weighted by its count instead of once per row (long texts excepted). The rows are local to the driver.
    """
    df = nan_to_null(df)
    texts, integers = string_columns(df), integer_columns(df)
    value, cnt, long = F.col("value"), F.col("cnt"), F.col("long")
    is_text = F.col("column").isin(texts) if texts else F.lit(False)
    is_integer = F.col("column").isin(integers) if integers else F.lit(False)
    number = F.when(is_integer, value.try_cast("bigint"))
    length = F.when(is_text, F.coalesce(long["length"], F.length(value)))

    def share(test: Column, on_long: str, name: str) -> Column:
        known = F.when(long.isNotNull(), long[on_long]).otherwise(test)
        return F.sum(F.when(is_text, F.when(known, cnt).otherwise(0))).alias(name)

    summary = (
        key_counts(df, flat_columns(df))
        .groupBy("column")
        .agg(
            *_class_measures(numeric_columns(df)),
            F.min(number).alias("low"),
            F.max(number).alias("high"),
            (F.sum(length * cnt) / F.sum(F.when(is_text, cnt))).alias("avg_len"),
            F.min(length).alias("min_len"),
            F.max(length).alias("max_len"),
            share(text.looks_numeric(value), "is_numeric", "n_numeric"),
            share(text.parse_timestamp(value).isNotNull(), "is_datetime", "n_datetime"),
            share(text.has_edge_space(value), "has_edge_space", "n_edge_space"),
            share(text.trimmed(value) == "", "is_empty", "n_empty"),
        )
    )
    summary = _with_texts(df, summary)
    nested = {f.name for f in df.schema} - set(flat_columns(df))
    if nested:  # arrays, maps and structs: only their nulls are counted
        summary = summary.unionByName(
            per_column(df, sorted(nested), lambda c: {"n_nonnull": F.count(col(c))}, "n_nonnull bigint"),
            allowMissingColumns=True,
        )
    facts = schema_rows(df).join(summary, "column", "left").withColumn("n_rows", F.lit(df.count()))
    flat = F.col("kind") != "other"
    nonnull = F.coalesce(F.col("n_nonnull"), F.lit(0))
    per_value = F.nullif(nonnull, F.lit(0)).cast("double")
    return collected(
        facts.withColumns(
            {
                "n_unique": F.when(flat, F.coalesce(F.col("n_unique"), F.lit(0))),
                "n_nonnull": nonnull,
                "n_null": F.col("n_rows") - nonnull,
                "datetime_rate": F.when(F.col("kind") == "datetime", F.lit(1.0)).otherwise(
                    F.col("n_datetime") / per_value
                ),
                "numeric_rate": F.col("n_numeric") / per_value,
            }
        )
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, range and population shape per numeric column.

    The columns are unpivoted and grouped by name, so one compiled aggregate serves them all; each task sends one
    row per column.
    """
    if not columns:
        return local_rows(df.sparkSession, [],
            "column string, n bigint, mean double, std double, variance double, low double, high double, "
            "g1 double, g2 double",
        )
    return (
        unpivot_numbers(df, columns)
        .groupBy("column")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.var_samp("value").alias("variance"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.skewness("value").alias("g1"),
            F.kurtosis("value").alias("g2"),
        )
    )
