"""Numbering rows within groups when one group may hold a large part of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number_within(df: DataFrame, group: str, chunk: Column, order: Column, name: str) -> DataFrame:
    """Add ``name`` = 1, 2, ... in the order ``(chunk, order)`` of each group.

    Rows are numbered inside chunks, and every chunk starts after the rows of the chunks before it. A chunk is a
    bounded slice of the group, so a hot group is spread over as many tasks as it has chunks; only one row per
    chunk is ordered per group. Chunk values must follow the row order.
    """
    cut = df.withColumn("_chunk", chunk)
    sizes = cut.groupBy(group, "_chunk").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(order))
    return (
        cut.withColumn("_place", inside)
        .join(starts, [group, "_chunk"])
        .withColumn(name, F.col("_start") + F.col("_place"))
        .drop("_chunk", "_place", "_start")
    )
