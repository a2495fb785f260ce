"""Column selectors by type, null normalisation, and the long form shared by all reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Columns per wide aggregate. Wider tables are read in several column-pruned aggregates, so that the generated
# code of one aggregate stays small enough to be compiled.
COLUMNS_PER_AGGREGATE = 48

_TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_FLOAT_TYPES = (T.FloatType, T.DoubleType)


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    """Integers, floats and decimals; booleans are not numbers here."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _TIME_TYPES)]


def flat_columns(df: DataFrame) -> list[str]:
    """Columns that hold one plain value per row (arrays, maps, structs and variants are left out)."""
    return [f.name for f in df.schema if kind_of(f.dataType) != "other"]


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(data_type, _TIME_TYPES):
        return "datetime"
    return "other"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are one thing: a missing value. Applied on entry to every operator."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, _FLOAT_TYPES)}
    if not floats:
        return df
    return df.select(
        *[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns]
    )


def local_rows(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """A few rows known to the driver (one per column or per pair of columns) as a DataFrame, sent as Arrow."""
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    arrays = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
    table = pa.Table.from_arrays(arrays, names=[f.name for f in fields])
    return spark.createDataFrame(table, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def schema_rows(df: DataFrame) -> DataFrame:
    """One row per column: ``column, position, data_type, kind, is_integer``."""
    rows = [
        (f.name, i, f.dataType.simpleString(), kind_of(f.dataType), isinstance(f.dataType, T.IntegralType))
        for i, f in enumerate(df.schema)
    ]
    return local_rows(
        df.sparkSession, rows, "column string, position int, data_type string, kind string, is_integer boolean"
    )


def per_column(
    df: DataFrame, columns: Sequence[str], measures: Callable[[str], dict[str, Column]], schema: str
) -> DataFrame:
    """Aggregate each column in one pass over the table and return one row per column.

    ``measures(column)`` names the aggregates; ``schema`` is their DDL, to which they are cast. The aggregate has
    no grouping key: only one partial row per task is exchanged, whatever the size of the table.
    """
    fields = T._parse_datatype_string(schema).fields
    result = None if columns else local_rows(df.sparkSession, [], f"column string, {schema}")
    for start in range(0, len(columns), COLUMNS_PER_AGGREGATE):
        chunk = list(columns[start : start + COLUMNS_PER_AGGREGATE])
        aggregates, structs = [], []
        for i, name in enumerate(chunk):
            wanted = measures(name)
            parts = [F.lit(name).alias("column")]
            for field in fields:
                alias = f"_{i}_{field.name}"
                aggregates.append(wanted[field.name].cast(field.dataType).alias(alias))
                parts.append(F.col(alias).alias(field.name))
            structs.append(F.struct(*parts))
        part = df.agg(*aggregates).select(F.inline(F.array(*structs)))
        result = part if result is None else result.unionByName(part)
    return result


def families(df: DataFrame, columns: Sequence[str]) -> list[list[str]]:
    """Columns grouped by data type, the unit in which they can be unpivoted without a cast."""
    groups: dict[str, list[str]] = {}
    for name in columns:
        groups.setdefault(df.schema[name].dataType.simpleString(), []).append(name)
    return list(groups.values())


def unpivot_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value double)`` for every non-null value of the numeric columns."""
    doubles = df.select(*[col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot([], [col(c) for c in columns], "column", "value").filter("value IS NOT NULL")


def collected(df: DataFrame) -> DataFrame:
    """Fix a report of one row per column (or per pair of columns) as local rows, so later steps reuse it.

    Only for reports whose row count is bounded by the schema, never for table data.
    """
    return local_rows(df.sparkSession, df.collect(), df.schema)
