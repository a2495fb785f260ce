"""The compact report of a table as text lines, built from the short reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablescope.operators.stats import column_shapes
from tablescope.plans.columns import (
    col,
    flat_columns,
    kind_of,
    local_rows,
    nan_to_null,
    numeric_columns,
    per_column,
    schema_rows,
    time_columns,
)
from tablescope.plans.passes import class_summary
from tablescope.plans.quantiles import exact_quantiles
from tablescope.plans.together import together

FIRST_ROWS = 100
HASHED_ROWS = 500
SHORT_LIST = 3
BEST_FEATURES = 5
RULE = "=" * 50
TIME_SHAPES = ["time_mean", "time_min", "time_q25", "time_q50", "time_q75", "time_max"]


def describe_all(df: DataFrame) -> DataFrame:
    """Every column described: counts for all, classes for non-numeric ones, moments and quartiles for numeric ones, and
    mean, ends and quartiles of time columns as times, cut to whole microseconds.

    ``column, position, count, unique, top, freq, mean, std, min, q25, q50, q75, max``, then ``time_mean, time_min, time_q25,
    time_q50, time_q75, time_max``; what does not apply is NULL.
    """
    df = nan_to_null(df)
    times = _time_shapes(df)
    others = [c for c in flat_columns(df) if c not in set(numeric_columns(df))]
    classes = class_summary(df, others).select(
        "column",
        F.col("n_nonnull").alias("class_n"),
        F.col("n_unique").alias("unique"),
        F.col("majority").alias("top"),
        F.col("majority_cnt").alias("freq"),
    )
    numbers = column_shapes(df).drop("position")
    flat = schema_rows(df).filter("kind != 'other'")
    joined = flat.join(classes, "column", "left").join(numbers, "column", "left").join(times, "column", "left")
    return joined.orderBy("position").select(
        "column",
        "position",
        F.coalesce("class_n", "n", F.lit(0)).alias("count"),
        "unique",
        "top",
        "freq",
        "mean",
        "std",
        F.col("low").alias("min"),
        "q25",
        F.col("median").alias("q50"),
        "q75",
        F.col("high").alias("max"),
        *TIME_SHAPES,
    )


def _time_shapes(df: DataFrame) -> DataFrame:
    """``column`` and ``TIME_SHAPES`` of each time column that holds times."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    columns = time_columns(df)
    micros = df.select(*[F.timestamp_diff("MICROSECOND", epoch, col(c).cast("timestamp_ntz")).alias(c) for c in columns])
    # The mean from the distance to the least value, which sums up without loss.
    ends = per_column(
        micros,
        columns,
        lambda c: {"n": F.count(col(c)), "low": F.min(col(c)), "high": F.max(col(c)), "total": F.sum(col(c).cast("decimal(38,0)"))},
        "n bigint, low bigint, high bigint, total decimal(38,0)",
    )
    quartiles = exact_quantiles(micros, columns, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    # Integer parts are cut towards the past, before 1970 too.
    mean = F.floor(F.col("total") / F.col("n")).cast("bigint")
    values = [mean, F.col("low"), *[F.floor(q).cast("bigint") for q in ("q25", "q50", "q75")], F.col("high")]
    shapes = [F.timestamp_add("MICROSECOND", v, epoch).alias(name) for name, v in zip(TIME_SHAPES, values, strict=True)]
    return ends.join(quartiles, "column").select("column", *shapes)


def context_sample(
    df: DataFrame, rows: int = FIRST_ROWS, method: str = "first", order_by: Sequence[str] | None = None
) -> DataFrame:
    """A few rows to show: the ``first`` under ``order_by``, or picked over the whole table by ``hash``.

    The hash pick is the same for any partitioning of the table; the usual number is ``HASHED_ROWS``. Without
    ``order_by`` the first rows are those in the order of all columns, since rows have no order of their own.
    """
    df = nan_to_null(df)
    columns = [col(c) for c in flat_columns(df)]
    if method == "hash":
        return df.orderBy(F.md5(_portable(df)), *columns).limit(rows)
    if method != "first":
        raise ValueError("method is 'first' or 'hash'")
    return df.orderBy(*([col(c) for c in order_by] if order_by else columns)).limit(rows)


def _portable(df: DataFrame) -> Column:
    """A row as text that any engine can write: numbers with six decimals, times in microseconds, null as nothing."""

    def written(field: T.StructField) -> Column:
        kind = kind_of(field.dataType)
        value = col(field.name)
        if kind == "numeric":
            value = value.cast("decimal(38,6)")
        if kind == "datetime":
            value = F.unix_micros(value.cast("timestamp_ltz"))
        return F.coalesce(value.cast("string"), F.lit(""))

    return F.concat_ws("|", *[written(f) for f in df.schema if kind_of(f.dataType) != "other"])


def dataset_info(
    df: DataFrame, size_mb: float, score: DataFrame, targets: DataFrame, time_columns: DataFrame
) -> DataFrame:
    """One row: rows, columns, size, grade, score, whether it is a time series, and the first target candidate."""
    target = targets.orderBy(F.desc("score"), "position").first()
    graded = score.select("grade", "total").first()
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(float(size_mb)).alias("file_size_mb"),
        F.lit(graded["grade"]).alias("quality_grade"),
        F.lit(graded["total"]).alias("quality_score"),
        F.lit(time_columns.first() is not None).alias("has_time_series"),
        F.lit(target["column"] if target else None).cast("string").alias("target_column"),
    )


def _rows_as_lines(title: str, df: DataFrame) -> list[str]:
    """A short report as a title and one ``name=value`` line per row; nothing if it has no rows."""
    rows = df.collect()
    shown = [", ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None) for r in rows]
    return [f"{title}:", *[f"  - {line}" for line in shown], ""] if shown else []


def _block(parts: list[tuple[str, DataFrame]]) -> list[str]:
    return [line for title, df in parts for line in _rows_as_lines(title, df)]


def schema_lines(report: dict[str, DataFrame]) -> list[str]:
    """Shape, columns by type, mixed columns, keys, the likely target, and the time structure."""
    parts = [
        ("Shape", report["shape"].select("rows", "cols")),
        ("Columns by type", report["column_categories"].filter("n_columns > 0")),
        ("Mixed columns", report["mixed_columns"].select("column", "types_found")),
        ("Primary key candidates", report["primary_keys"].select("column", "confidence")),
        ("Likely target", report["target_candidates"].limit(1).select("column", "score", "reasons")),
    ]
    if "time_frequency" in report:
        parts += [
            ("Time column", report["time_frequency"].select("column", "frequency")),
            ("Time span", report["temporal_span"].select("start_ts", "end_ts", "duration_days", "n_records")),
        ]
    return _block(parts)


def quality_lines(report: dict[str, DataFrame]) -> list[str]:
    """Score, missing values, duplicates, outliers, and the first three imbalanced and badly formatted columns."""
    balance = report["class_imbalance"].limit(SHORT_LIST)
    return _block(
        [
            ("Quality score", report["quality_score"]),
            ("Missing values", report["missing_summary"]),
            ("Duplicates", report["duplicate_rows"]),
            ("Outliers", report["outlier_summary"]),
            ("Class imbalance", balance.select("column", "imbalance_ratio", "severity", "recommendation")),
            ("Format issues", report["format_issues"].limit(SHORT_LIST).select("column", "issues")),
        ]
    )


def profiling_lines(report: dict[str, DataFrame]) -> list[str]:
    """Skew, tails, distributions, correlation, the five best features, and the clusters."""
    shapes = report["normality_test"].select("column", "is_normal", "distribution_type")
    extremes = Window.partitionBy("direction").orderBy(F.desc(F.abs("correlation")), "position")  # at most ten rows each
    pairs = report["correlation_top"].withColumn("place", F.row_number().over(extremes)).filter("place = 1")
    parts = [
        ("Skewed columns", report["skewed_columns"]),
        ("Heavy or light tails", report["high_kurtosis"]),
        ("Distributions", shapes),
        ("Correlation", report["correlation_summary"]),
        ("Strongest pairs", pairs.select("direction", "col1", "col2", "correlation")),
        ("Feature importance", report["feature_importance"].limit(BEST_FEATURES).drop("position")),
    ]
    if "kmeans_k_scores" in report:
        parts += [
            ("Clusters", report["kmeans_k_scores"].filter("is_best").drop("is_best")),
            ("Cluster sizes", report["kmeans_sizes"]),
        ]
    return _block(parts)


def _table_lines(df: DataFrame) -> list[str]:
    """A short DataFrame as a text table, one line per row."""
    lines = [" | ".join(df.columns)]
    return lines + [" | ".join("" if v is None else str(v) for v in row) for row in df.collect()]


def report_context(
    clean: DataFrame,
    size_mb: float,
    schema: dict[str, DataFrame] | None = None,
    quality: dict[str, DataFrame] | None = None,
    profiling: dict[str, DataFrame] | None = None,
    sample_rows: int = FIRST_ROWS,
    sample_method: str = "first",
) -> DataFrame:
    """``line_no, section, text``: overview, schema, quality, description and sample of a table as text lines.

    Sections whose report is not given are left out; the statistical profile is optional and off by default. Only
    rows of short reports and the bounded sample pass through the driver.
    """
    sample = context_sample(clean, sample_rows, sample_method)
    how = "random rows" if sample_method == "hash" else "first rows"
    overview = [f"rows: {clean.count()}", f"size: {size_mb:.2f} MB", f"columns: {', '.join(clean.columns)}"]
    sections: list[tuple[str, Callable[[], list[str]]]] = [("DATASET OVERVIEW", lambda: overview)]
    if schema:
        sections.append(("SCHEMA INTELLIGENCE", lambda: schema_lines(schema)))
    if quality:
        sections.append(("DATA QUALITY ASSESSMENT", lambda: quality_lines(quality)))
    if profiling:
        sections.append(("STATISTICAL PROFILE", lambda: profiling_lines(profiling)))
    sections.append(("DESCRIPTIVE STATISTICS", lambda: _table_lines(describe_all(clean).drop("position"))))
    sections.append((f"DATA SAMPLE ({how})", lambda: _table_lines(sample)))
    bodies = together(clean.sparkSession, [body for _, body in sections])
    lines = [
        (title, text)
        for (title, _), body in zip(sections, bodies)
        for text in (RULE, title, RULE, *body, "")
    ]
    numbered = [(i + 1, title, text) for i, (title, text) in enumerate(lines)]
    return local_rows(clean.sparkSession, numbered, "line_no int, section string, text string")


def context_text(context: DataFrame) -> str:
    """The lines as one text."""
    return "\n".join(r["text"] for r in context.orderBy("line_no").collect())
