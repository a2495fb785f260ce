"""Exact duplicate rows without moving whole rows when there is nothing to find."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.plans.columns import col, nan_to_null

# Suspect hashes that may be broadcast (eight bytes each).
BROADCAST_HASHES = 1_000_000


def comparable(value: Column, data_type: T.DataType) -> Column:
    """A value that can be hashed and grouped: maps become sorted entries and variants their JSON text, at any depth."""
    if isinstance(data_type, T.VariantType):
        return F.to_json(value)
    if isinstance(data_type, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                comparable(e["key"], data_type.keyType).alias("key"), comparable(e["value"], data_type.valueType).alias("value")
            ),
        )
        return F.array_sort(entries)
    if isinstance(data_type, T.ArrayType) and _has_odd_types(data_type):
        return F.transform(value, lambda e: comparable(e, data_type.elementType))
    if isinstance(data_type, T.StructType) and _has_odd_types(data_type):
        fields = [comparable(value[f.name], f.dataType).alias(f.name) for f in data_type]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_odd_types(data_type: T.DataType) -> bool:
    if isinstance(data_type, (T.MapType, T.VariantType)):
        return True
    if isinstance(data_type, T.ArrayType):
        return _has_odd_types(data_type.elementType)
    return isinstance(data_type, T.StructType) and any(_has_odd_types(f.dataType) for f in data_type)


def duplicated_rows(df: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> int:
    """Rows beyond the first of each group of identical rows; nulls are equal to each other.

    First only a 64-bit hash per row is exchanged. Rows whose hash is single cannot have a copy. If no hash
    repeats, the answer is 0; if few do, their rows are picked by a broadcast of the checked hash list and compared
    in full; if many do, all rows are compared in full, which then combines well on the map side. The answer is
    exact in all three cases, because hash equality alone never counts as a duplicate.
    """
    df = nan_to_null(df)
    df = df.select(*[comparable(col(f.name), f.dataType).alias(f.name) for f in df.schema])
    columns = [col(c) for c in df.columns]
    hashed = df.withColumn("__row_hash", F.xxhash64(*columns))
    repeated = hashed.groupBy("__row_hash").agg(F.count("*").alias("__copies")).filter("__copies > 1").select("__row_hash")
    # Kept between its count and its use, so that the table is hashed once for both; a lost block is computed again.
    repeated = repeated.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        suspects = repeated.count()
        if suspects == 0:
            return 0
        rows = df
        if suspects <= broadcast_hashes:
            rows = hashed.join(F.broadcast(repeated), "__row_hash", "left_semi").drop("__row_hash")
        extra = rows.groupBy(*columns).agg(F.count("*").alias("__copies")).agg(F.sum(F.col("__copies") - 1)).first()[0]
    finally:
        repeated.unpersist()
    return extra or 0
