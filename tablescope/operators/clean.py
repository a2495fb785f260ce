"""Cleaning: drop empty rows, trim text, fill numbers with the median and everything else with the mode."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.text import trimmed
from tablescope.plans.columns import (
    col,
    flat_columns,
    nan_to_null,
    numeric_columns,
    per_column,
    string_columns,
)
from tablescope.plans.passes import class_summary, key_counts, text_key
from tablescope.plans.quantiles import exact_quantiles
from tablescope.plans.together import together


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Without the rows in which every column is missing."""
    return nan_to_null(df).dropna(how="all")


def trim_strings(df: DataFrame) -> DataFrame:
    texts = set(string_columns(df))
    return df.select(*[trimmed(col(c)).alias(c) if c in texts else col(c) for c in df.columns])


def medians(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, median)`` of the numeric columns that have values."""
    columns = numeric_columns(df) if columns is None else columns
    return exact_quantiles(nan_to_null(df), columns, [0.5], ["median"])


def modes(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """The most frequent value of each column that has values, as text; ties go to the smallest value.

    Values are counted over the cluster and the winner is picked by an aggregate that combines on the map side, so
    no task ever holds all distinct values of a column.
    """
    numeric = set(numeric_columns(df))
    columns = [c for c in flat_columns(df) if c not in numeric] if columns is None else columns
    result = {}
    for r in class_summary(df, columns).collect():
        name = r["column"]
        result[name] = _smallest_tied_text(df, name, r["majority_cnt"]) if r["n_long"] else r["majority"]
    return result


def _smallest_tied_text(df: DataFrame, name: str, count: int) -> str:
    """The smallest of the texts that occur ``count`` times, for a column with long texts, which are counted by
    digest. If the most frequent text occurs once, that is the smallest text of all."""
    value = df.select(col(name).alias("value")).filter("value IS NOT NULL")
    if count > 1:
        tied = key_counts(df, [name]).filter(F.col("cnt") == count).select(F.col("value").alias("key"))
        value = value.withColumn("key", text_key(F.col("value"))).join(tied, "key", "left_semi")
    return value.agg(F.min("value")).first()[0]


def _with_gaps(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that miss at least one value. Only these need a median or a mode."""
    counts = per_column(df, columns, lambda c: {"gaps": F.count_if(col(c).isNull())}, "gaps bigint")
    return [r["column"] for r in counts.collect() if r["gaps"]]


def fill_medians(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric gaps filled with the column's median. A filled column becomes double, since a median may be
    fractional; a column without any value stays empty."""
    df = nan_to_null(df)
    gaps = _with_gaps(df, numeric_columns(df)) if columns is None else columns
    return _with_medians(df, gaps, _median_values(df, gaps))


def _median_values(df: DataFrame, gaps: list[str]) -> dict[str, float]:
    return {r["column"]: r["median"] for r in medians(df, gaps).collect()} if gaps else {}


def _with_medians(df: DataFrame, gaps: list[str], found: dict[str, float]) -> DataFrame:
    return df.select(
        *[
            F.coalesce(col(c).cast("double"), F.lit(found.get(c)).cast("double")).alias(c) if c in gaps else col(c)
            for c in df.columns
        ]
    )


def fill_modes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Gaps of text, time and boolean columns filled with the most frequent value.

    A text column without any value is filled with ``'Unknown'``; other columns without values stay empty.
    """
    df = nan_to_null(df)
    numeric = set(numeric_columns(df))
    gaps = _with_gaps(df, [c for c in flat_columns(df) if c not in numeric]) if columns is None else columns
    return _with_modes(df, gaps, modes(df, gaps) if gaps else {})


def _with_modes(df: DataFrame, gaps: list[str], found: dict[str, str]) -> DataFrame:
    texts = set(string_columns(df))

    def filled(name: str):
        value = found.get(name, "Unknown" if name in texts else None)
        return F.coalesce(col(name), F.lit(value).cast(df.schema[name].dataType)).alias(name)

    return df.select(*[filled(c) if c in gaps else col(c) for c in df.columns])


def clean_table(df: DataFrame) -> DataFrame:
    """The whole cleaning: empty rows out, text trimmed, numbers filled by median and the rest by mode.

    One aggregate finds the columns with gaps; medians and modes are computed for those only. The result is a
    projection of the input with the fill values as constants. Where no row is empty, no row filter is left in the
    plan either, since it would make every later scan read all columns.
    """
    df = nan_to_null(df)
    columns = flat_columns(df)
    empty = reduce(and_, [col(c).isNull() for c in df.columns])
    counts = df.agg(F.count_if(empty).alias("n"), *[F.count_if(col(c).isNull()).alias(f"g_{c}") for c in columns]).first()
    gaps = [c for c, missing in zip(columns, counts[1:]) if missing > counts[0]]
    numeric = set(numeric_columns(df))
    df = trim_strings(df.dropna(how="all") if counts[0] else df)
    numbers, others = [c for c in gaps if c in numeric], [c for c in gaps if c not in numeric]
    found_medians, found_modes = together(
        df.sparkSession, [lambda: _median_values(df, numbers), lambda: modes(df, others) if others else {}]
    )
    return _with_modes(_with_medians(df, numbers, found_medians), others, found_modes)
