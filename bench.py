"""Time the headline queries on one machine and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from query_set.spark_queries import queries  # noqa: E402
from query_set.views import table  # noqa: E402
from tablescope import build_session, profile_table  # noqa: E402
from tablescope.operators.importance import mutual_information  # noqa: E402
from tablescope.operators.schema import column_profile  # noqa: E402
from tablescope.operators.stats import descriptive_stats  # noqa: E402

HEADLINE = [
    "csv_source",
    "load_analyse_clean",
    "descriptive_stats",
    "column_profile",
    "semantic_types",
    "time_frequency",
    "quality_score",
    "duplicate_rows",
    "iqr_outliers",
    "class_imbalance",
    "clean_table",
    "correlation_pairs",
    "normality_test",
    "mi_regression",
    "variance_entropy_rank",
    "hist_grid",
    "time_series",
    "describe_all",
    "conversation_context",
    "llm_json_extract",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = queries()
    seconds = {}

    def clock(name, action) -> None:
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    # A run over the smallest table loads the classes, so that the first query does not pay for the start of the JVM.
    profile_table(table(spark, folder, "region"), run_clustering=False).release()
    for name in HEADLINE:
        clock(name, lambda: every[name](spark, folder).write.format("noop").mode("overwrite").save())
    # More than a million rows at sf0.1: lineitem and a copy of it with order keys of its own.
    lineitem = table(spark, folder, "lineitem")
    twice = lineitem.unionByName(lineitem.withColumn("l_orderkey", F.col("l_orderkey") + 1_000_000_000))
    for name, operator in (
        ("descriptive_stats_twice", descriptive_stats),
        ("mi_regression_twice", lambda df: mutual_information(df, "l_extendedprice")),
        ("column_profile_twice", column_profile),
    ):
        clock(name, lambda: operator(twice).write.format("noop").mode("overwrite").save())
    # The whole report of lineitem, without and with clustering of all rows.
    for name, clustering in (("report", False), ("report_with_clusters", True)):
        clock(name, lambda: profile_table(
            table(spark, folder, "lineitem"), run_clustering=clustering, keep=True, partitions=int(cpus)
        ).release())
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
