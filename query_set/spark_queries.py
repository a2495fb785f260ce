"""One query per operator: each takes ``(spark, folder)`` and returns a DataFrame of flat columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from query_set.views import table
from tablescope import session
from tablescope.operators import charts, clean, cluster, context, conversations, importance, names, quality, schema, stats
from tablescope.plans.columns import collected
from tablescope.profile import load_analyse_clean, profile_table, profiling_report
from tablescope.sources.csv import load_csv

Query = Callable[[SparkSession, str], DataFrame]

NUMERIC_LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session that names none gets one of its own."""
    try:
        return session.shared_folder(spark)
    except RuntimeError:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise
        return tempfile.mkdtemp(prefix="queries-")


def on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    """A query that applies an operator to one table or view."""
    return lambda spark, folder: operator(table(spark, folder, name))


def _write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    df.write.options(
        header=True,
        encoding=encoding,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        timestampNTZFormat="yyyy-MM-dd HH:mm:ss",
    ).csv(path)


def csv_source(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written as CSV, one part in UTF-8 and one in Latin-1, and read back without naming an encoding."""
    customers = table(spark, folder, "customer").withColumn("note", F.concat(F.col("c_mktsegment"), F.lit(" né à Köln")))
    base = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rich = F.col("c_acctbal") >= 0
    _write_csv(customers.filter(rich), f"{base}/one")
    _write_csv(customers.filter(~rich), f"{base}/two", "ISO-8859-1")
    return load_csv(spark, f"{base}/*").df


def normalize_names(spark: SparkSession, folder: str) -> DataFrame:
    messy = [" Order-Key ", "order.key", "Status [x]", "Price (USD)", "order key", "ORDER__Priority/"]
    return names.normalize_names(table(spark, folder, "orders").toDF(*messy))


def load_and_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The whole run from CSV files to the clean table; the text is parsed once, and the passes read Parquet."""
    base = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    _write_csv(table(spark, folder, "orders_dirty"), f"{base}/text")
    return load_analyse_clean(spark, f"{base}/text", run_clustering=False, with_charts=False, stage_to=f"{base}/staged").clean


def time_frequency(spark: SparkSession, folder: str) -> DataFrame:
    events = schema.time_frequency(table(spark, folder, "events"), "ts")
    return events.unionByName(schema.time_frequency(table(spark, folder, "lineitem"), "l_shipdate"))


def time_frequency_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct hours, days, weeks and so on in which there are orders or events, each as a time column."""
    orders, events = table(spark, folder, "orders"), table(spark, folder, "events")
    found = []
    for df, ts, steps in ((events, "ts", ["hour"]), (orders, "o_orderdate", ["day", "week", "month", "quarter", "year"])):
        for step in steps:
            times = df.select(F.date_trunc(step, ts).cast("timestamp_ntz").alias(step)).distinct()
            found.append(schema.time_frequency(times, step))
    return reduce(DataFrame.unionByName, found)


def dashboard_charts(spark: SparkSession, folder: str) -> DataFrame:
    """Every chart of the whole analysis with its number of rows."""
    profile = profile_table(table(spark, folder, "orders_dirty"), run_clustering=False)
    counts = [df.select(F.lit(name).alias("chart")).groupBy("chart").agg(F.count("*").alias("n_rows")) for name, df in profile.charts.items()]
    return reduce(DataFrame.unionByName, counts)


def quality_rows(df: DataFrame) -> DataFrame:
    """The whole quality report in one long table: ``section, item, metric, value``."""
    report = quality.quality_report(df)

    def rows(section: str, source: DataFrame, item, metrics: list[str]) -> DataFrame:
        wide = source.select(item.alias("item"), *[F.col(m).cast("double").alias(m) for m in metrics])
        return wide.unpivot(["item"], metrics, "metric", "value").withColumn("section", F.lit(section))

    whole = F.lit("table")
    parts = [
        rows("missing", report["missing_values"], F.col("column"), ["missing_count", "missing_pct"]),
        rows(
            "missing",
            report["missing_summary"],
            whole,
            ["total_missing", "overall_pct", "rows_with_any_missing", "rows_complete"],
        ),
        rows("duplicates", report["duplicate_rows"], whole, ["exact_duplicates", "exact_pct"]),
        rows("format", report["format_issues"], F.col("column"), ["issue_count"]),
        rows("outliers", report["iqr_outliers"], F.col("column"), ["outlier_count", "outlier_pct"]),
        rows("imbalance", report["class_imbalance"], F.col("column"), ["n_classes", "imbalance_ratio"]),
        rows(
            "score",
            report["quality_score"],
            whole,
            ["completeness", "uniqueness", "consistency", "validity", "total"],
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("section", "item", "metric", "value")


def profiling_rows(df: DataFrame) -> DataFrame:
    """The statistical report of a clean table in one long table: ``section, item, metric, value``."""
    report = profiling_report(df, "quality")

    def rows(section: str, source: DataFrame, item, metrics: list[str]) -> DataFrame:
        wide = source.select(item.alias("item"), *[F.round(F.col(m).cast("double"), 4).alias(m) for m in metrics])
        return wide.unpivot(["item"], metrics, "metric", "value").withColumn("section", F.lit(section))

    pair = F.concat("col1", F.lit(" & "), "col2")
    return (
        rows("moments", report["descriptive_stats"], F.col("column"), ["mean", "std", "median", "skewness", "kurtosis"])
        .unionByName(rows("correlation", report["correlation_pairs"], pair, ["correlation"]))
        .unionByName(rows("importance", report["feature_importance"], F.col("feature"), ["score"]))
        .select("section", "item", "metric", "value")
    )


def primary_keys_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of three tables, with the order of their rows given by another column."""
    reports = [
        schema.primary_keys(table(spark, folder, name), order_by=[by]).withColumn("table_name", F.lit(name))
        for name, by in (("events", "ts"), ("orders", "o_orderdate"), ("part", "p_partkey"))
    ]
    return reduce(DataFrame.unionByName, reports)


def context_lines(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "orders_dirty")
    report = schema.schema_report(raw)
    targets = [r["column"] for r in report["target_candidates"].collect()]
    health = quality.quality_report(raw, targets, report["facts"])
    return context.report_context(clean.clean_table(raw), 1.0, report, health)


def dataset_info(df: DataFrame) -> DataFrame:
    report = schema.schema_report(df)
    score = quality.quality_score(df)
    return context.dataset_info(clean.clean_table(df), 1.0, score, report["target_candidates"], report["time_columns"])


def kmeans(show: Callable[[cluster.Clustering], DataFrame]) -> Query:
    return lambda spark, folder: show(cluster.kmeans_search(clean.clean_table(table(spark, folder, "orders_dirty"))))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def queries() -> dict[str, Query]:
    return {
        # sources and preparation
        "csv_source": csv_source,
        "normalize_names": normalize_names,
        "clean_drop_empty_rows": on("orders_dirty", clean.drop_empty_rows),
        "clean_median_impute": on("orders_dirty", lambda df: clean.fill_medians(clean.drop_empty_rows(df))),
        "clean_trim": on("orders_dirty", clean.trim_strings),
        "clean_mode_impute": on(
            "orders_dirty", lambda df: clean.fill_modes(clean.trim_strings(clean.drop_empty_rows(df)))
        ),
        "clean_table": on("orders_dirty", clean.clean_table),
        "column_type_split": on("orders_dirty", schema.column_type_split),
        "dataset_shape": on("orders_dirty", schema.dataset_shape),
        "basic_schema": on("orders_dirty", schema.basic_schema),
        "load_analyse_clean": load_and_clean,
        # schema
        "column_profile": on("orders_dirty", schema.column_profile),
        "semantic_types": on("events_text", schema.semantic_types),
        "semantic_types_part": on("part", schema.semantic_types),
        "datetime_parse_rate": on("events_text", schema.datetime_parse_rates),
        "mixed_columns": on("events_text", schema.mixed_columns),
        "mixed_samples": on("events_text", schema.mixed_samples),
        "lexical_type_counts": on("events_text", schema.lexical_type_counts),
        "target_candidates": on("docs_labeled", schema.target_candidates),
        "primary_keys": on("part", schema.primary_keys),
        "primary_keys_ordered": primary_keys_ordered,
        "best_time_column": on("events_text", schema.time_column_rows),
        "temporal_span": on("events", lambda df: schema.temporal_span(df, "ts")),
        "time_frequency": time_frequency,
        "time_frequency_steps": time_frequency_steps,
        "column_categories": on("orders_dirty", schema.column_categories),
        "schema_report": on("orders_dirty", schema.schema_display),
        # quality
        "missing_values": on("orders_dirty", quality.missing_values),
        "missing_summary": on("orders_dirty", quality.missing_summary),
        "duplicate_rows": on("orders_dirty", quality.duplicate_rows),
        "duplicate_subsets": on("orders_dirty", quality.duplicate_subsets),
        "format_whitespace": on("orders_dirty", quality.format_whitespace),
        "format_case_variants": on("orders_dirty", quality.format_case_variants),
        "format_empty_strings": on("orders_dirty", quality.format_empty_strings),
        "format_issues": on("orders_dirty", quality.format_issues),
        "iqr_outliers": on("orders_dirty", lambda df: quality.iqr_outliers(df, digits=6)),
        "outlier_summary": on("orders_dirty", quality.outlier_summary),
        "outlier_samples": on("orders_dirty", quality.outlier_samples),
        "class_imbalance": on("docs_labeled", quality.class_imbalance),
        "class_distribution": on("docs_labeled", quality.class_distribution),
        "quality_score": on("orders_dirty", quality.quality_score),
        "missing_display": on("orders_dirty", quality.missing_display),
        "outlier_display": on(
            "orders_dirty", lambda df: quality.outlier_display(df, quality.iqr_outliers(df, digits=6))
        ),
        "quality_report": on("orders_dirty", quality_rows),
        # statistics
        "descriptive_stats": on("lineitem", lambda df: stats.descriptive_stats(df, digits=6)),
        "skewed_columns": on("events", stats.skewed_columns),
        "high_kurtosis": on("documents", stats.high_kurtosis),
        "normality_test": on("supplier", stats.normality_test),
        "distribution_types": on("documents", stats.distribution_types),
        "correlation_matrix": on("lineitem", lambda df: rounded(stats.correlation_matrix(df), 6, "r")),
        "correlation_pairs": on("lineitem", stats.correlation_report),
        "correlation_top": on("lineitem", stats.correlation_top),
        "correlation_summary": on("lineitem", stats.correlation_summary),
        "correlation_top15": on("lineitem", stats.correlation_top15),
        "mi_classification": on("docs_labeled", lambda df: importance.mutual_information(df, "quality", digits=6)),
        "mi_regression": on("lineitem", lambda df: importance.mutual_information(df, "l_extendedprice", digits=6)),
        "mi_neighbours_classification": on(
            "docs_labeled", lambda df: importance.neighbour_information(df, "quality", digits=6)[1]
        ),
        "mi_neighbours_regression": on(
            "docs_labeled", lambda df: importance.neighbour_information(df, "n_chars", digits=6)[1]
        ),
        "variance_entropy_rank": on("lineitem", importance.variance_entropy_rank),
        "feature_importance": on("docs_labeled", lambda df: importance.feature_importance(df, "quality")),
        "kmeans_k_scores": kmeans(lambda found: found.k_scores()),
        "kmeans_sizes": kmeans(lambda found: found.sizes()),
        "kmeans_centers": kmeans(lambda found: found.centers()),
        "kmeans_labels": kmeans(lambda found: found.labelled),
        "profiling_report": on("docs_labeled", profiling_rows),
        # chart data
        "hist_top_variance": on(
            "lineitem", lambda df: rounded(charts.hist_top_variance(df, NUMERIC_LINEITEM), 6, "bin_start", "bin_end", "mean", "std")
        ),
        "hist_grid": on("lineitem", lambda df: rounded(charts.hist_grid(df, NUMERIC_LINEITEM), 6, "bin_start", "bin_end")),
        "composition": on("part", lambda df: rounded(charts.composition(df, "p_brand"), 6, "share_pct")),
        "scatter_points": on(
            "lineitem",
            lambda df: rounded(charts.scatter_points(df, "l_orderkey", "l_partkey", "l_returnflag"), 6, "x_start", "y_start"),
        ),
        "scatter_r": on("lineitem", lambda df: rounded(charts.scatter_r(df, "l_orderkey", "l_partkey"), 6, "r")),
        "category_mean": on(
            "customer",
            lambda df: rounded(charts.category_mean(df, "c_mktsegment", "c_acctbal"), 6, "mean_value", "overall_mean"),
        ),
        "correlation_heatmap": on("lineitem", charts.correlation_heatmap),
        "strongest_pair": on("events", lambda df: rounded(stats.strongest_pair(df), 6, "r")),
        "chart_missing": on("orders_dirty", lambda df: charts.chart_missing(quality.missing_values(df))),
        "chart_box": on(
            "orders_dirty", lambda df: charts.chart_box(clean.clean_table(df), quality.iqr_outliers(df))
        ),
        "chart_class_balance": on(
            "docs_labeled",
            lambda df: rounded(charts.chart_class_balance(df, collected(quality.class_imbalance(df))), 6, "balanced_pct"),
        ),
        "chart_importance": on(
            "docs_labeled", lambda df: charts.chart_importance(importance.feature_importance(df, "quality"))
        ),
        "chart_corr_pairs": on("lineitem", lambda df: charts.chart_corr_pairs(stats.correlation_top(df))),
        "time_series": on(
            "events", lambda df: rounded(charts.time_series(df, "ts", ["user_id", "value"], "1 hour"), 6, "mean_value")
        ),
        "chart_clusters": kmeans(charts.chart_clusters),
        "chart_silhouette": kmeans(charts.chart_silhouette),
        "chart_gauge": on("orders_dirty", lambda df: charts.chart_gauge(quality.quality_score(df))),
        "chart_dimensions": on("orders_dirty", lambda df: charts.chart_dimensions(quality.quality_score(df))),
        "dashboard_charts": dashboard_charts,
        # context, conversations, responses
        "describe_all": on(
            "orders_dirty", lambda df: rounded(context.describe_all(df), 6, "mean", "std", "min", "q25", "q50", "q75", "max")
        ),
        "context_sample": on("orders_dirty", context.context_sample),
        "context_sample_large": on("orders_dirty", lambda df: context.context_sample(df, context.HASHED_ROWS, "hash")),
        "report_context": context_lines,
        "dataset_info": on("orders_dirty", dataset_info),
        "conversation_context": on("conversations", conversations.conversation_context),
        "conversation_context_gaps": on("conversations_gaps", conversations.conversation_context),
        "conversation_context_whole": on(
            "conversations_gaps",
            lambda df: conversations.conversation_context(df, 2, "Rows: 9", "2024-01-01 10:00:00"),
        ),
        "conversation_messages": on("conversations", conversations.conversation_messages),
        "conversation_queries": on("conversations", conversations.conversation_queries),
        "llm_json_extract": on("llm_responses", lambda df: conversations.llm_json_extract(df, "item_id", "response")),
        "llm_insight_rows": on("llm_responses", lambda df: conversations.llm_insight_rows(df, "item_id", "response")),
    }
