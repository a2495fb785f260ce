"""Median gap between consecutive times, without ever sorting the table in one task."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescope.functions.text import parse_timestamp
from tablescope.plans.columns import col, local_rows, string_columns
from tablescope.plans.quantiles import BRACKET_ROWS, order_statistics

# Distinct times per window partition that one task sorts.
TIMES_PER_BUCKET = 500_000
MAX_BUCKETS = 5_000


def parsed_times(df: DataFrame, column: str) -> DataFrame:
    """The column as ``ts timestamp_ntz``; values that are no date are dropped."""
    value = parse_timestamp(col(column)) if column in string_columns(df) else col(column).cast("timestamp_ntz")
    return df.select(value.alias("ts")).filter("ts IS NOT NULL")


def distinct_times(df: DataFrame, column: str) -> DataFrame:
    """``(us, cnt)``: each time in microseconds since 1970, and how many records have it."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("ts"))
    return parsed_times(df, column).groupBy(micros.alias("us")).agg(F.count("*").alias("cnt"))


def time_gaps(times: DataFrame, distinct: int, times_per_bucket: int = TIMES_PER_BUCKET) -> DataFrame:
    """``gap_us``: the gaps between consecutive distinct times.

    The times are cut into buckets of equal depth (they hold no repeats, so no bucket can run hot); gaps inside a
    bucket come from a window over that bucket, gaps between buckets from a window over one row per bucket.
    """
    buckets = min(MAX_BUCKETS, -(-distinct // times_per_bucket))
    if buckets > 1:
        points = [i / buckets for i in range(1, buckets)]
        inner = times.agg(F.percentile_approx(F.col("us").cast("double"), points, 10_000)).first()[0]
        splits = [float("-inf"), *sorted(set(inner)), float("inf")]
        times = times.withColumn("place", F.col("us").cast("double"))
        times = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(times)
    else:
        times = times.withColumn("bucket", F.lit(0.0))
    before = F.lag("us").over(Window.partitionBy("bucket").orderBy("us"))
    inside = times.select((F.col("us") - before).alias("gap_us"))
    ends = times.groupBy("bucket").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    last = F.lag("last").over(Window.orderBy("bucket"))  # over at most MAX_BUCKETS rows
    between = ends.select((F.col("first") - last).alias("gap_us"))
    return inside.unionByName(between).filter("gap_us IS NOT NULL")


def median_gap(
    df: DataFrame,
    column: str,
    times_per_bucket: int = TIMES_PER_BUCKET,
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """``(n_records, median_gap_us)``; the median is NULL below three records."""
    spark = df.sparkSession
    times = distinct_times(df, column)
    n_records, distinct = times.agg(F.coalesce(F.sum("cnt"), F.lit(0)), F.count("*")).first()
    gaps, zeros = n_records - 1, n_records - distinct
    median = None
    if n_records >= 3:
        # The gaps sorted ascending start with the zeros; other places are looked up among the gaps between
        # distinct times. If the median lies among the zeros, nothing has to be sorted.
        places = sorted({(gaps - 1) // 2, gaps // 2})
        wanted = [("gap_us", p - zeros) for p in places if p >= zeros]
        found = {}
        if wanted:
            steps = time_gaps(times, distinct, times_per_bucket)
            if distinct > bracket_rows:  # read several times by the search
                steps = steps.persist(StorageLevel.MEMORY_AND_DISK)
            found = order_statistics(steps, wanted, {"gap_us": distinct - 1}, bracket_rows)
            steps.unpersist()
        values = [found.get(("gap_us", p - zeros), 0.0) for p in places]
        median = sum(values) / len(values)
    return local_rows(spark, [(n_records, median)], "n_records bigint, median_gap_us double")
