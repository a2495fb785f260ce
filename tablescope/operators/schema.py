"""What each column means: semantic types, mixed content, targets, keys and time structure.

Every report takes either a table or the facts of one (``plans.passes.column_facts``), so a caller with several
questions computes the facts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescope.functions import text
from tablescope.plans.columns import (
    col,
    collected,
    flat_columns,
    local_rows,
    nan_to_null,
    string_columns,
)
from tablescope.plans.gaps import median_gap, parsed_times
from tablescope.functions.grades import frequency_label
from tablescope.plans.order import rising_columns
from tablescope.plans.passes import column_facts
from tablescope.plans.together import together

SEMANTIC_TYPES = ("numeric", "categorical", "datetime", "boolean", "text", "identifier", "unknown")

# Two-word sets that mean yes or no.
BOOLEAN_PAIRS = [
    ("0", "1"),
    ("no", "yes"),
    ("false", "true"),
    ("n", "y"),
    ("No", "Yes"),
    ("False", "True"),
    ("N", "Y"),
    ("Female", "Male"),
    ("female", "male"),
    ("F", "M"),
    ("f", "m"),
]

# Name parts that point to a prediction target, and to a time column.
TARGET_KEYWORDS = (
    "target", "label", "class", "outcome", "result", "flag", "status", "churn", "default", "fraud", "response",
    "survived", "diagnosis", "prediction", "y", "output",
)
TIME_KEYWORDS = ("date", "time", "timestamp", "datetime", "created", "updated", "period")

SAMPLES = 3
MIXED_LOW, MIXED_HIGH = 0.3, 0.95
DATETIME_RATE = 0.8


def semantic_type() -> Column:
    """The semantic type of a row of facts; the first rule that holds wins."""
    unique, rows = F.col("n_unique"), F.col("n_rows")
    is_number = F.col("kind").isin("numeric", "boolean")
    is_text = F.col("kind") == "string"
    yes_no = F.lit(False)
    for low, high in BOOLEAN_PAIRS:
        yes_no = yes_no | ((F.col("value_min") == low) & (F.col("value_max") == high))
    few = (unique <= 30) | ((unique / rows.cast("double") < 0.05) & (rows > 100))
    return (
        F.when(is_text & (unique == 2) & yes_no, "boolean")
        .when(is_number & (unique <= 2), "boolean")
        .when(is_number & (unique <= 20) & (rows > 50), "categorical")
        .when(is_number, "numeric")
        .when(F.coalesce(F.col("datetime_rate"), F.lit(0.0)) >= DATETIME_RATE, "datetime")
        .when(F.col("kind") == "datetime", "datetime")
        .when(is_text & (unique == rows) & (rows > 10), "identifier")
        .when(is_text & few, "categorical")
        .when(is_text & (F.col("avg_len") > 50), "text")
        .when(is_text, "categorical")
        .otherwise("unknown")
    )


def _facts(df: DataFrame, facts: DataFrame | None) -> DataFrame:
    return column_facts(df) if facts is None else facts


def semantic_types(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``column, position, data_type, semantic_type``."""
    return _facts(df, facts).select("column", "position", "data_type", semantic_type().alias("semantic_type")).orderBy(
        "position"
    )


def sample_values(df: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The smallest distinct values per column: ``column, rank, value``. Repeatable on any partitioning.

    Each rank is one aggregate over the table that looks for the smallest value above the one before, so no values
    are exchanged but one candidate per task and column.
    """
    df = nan_to_null(df)
    columns = flat_columns(df)
    last: dict[str, str | None] = {}
    rows = []
    for rank in range(1, samples + 1):
        left = [c for c in columns if rank == 1 or last[c] is not None]
        if not left:
            break

        def smallest(name: str) -> Column:
            value = col(name)
            if rank > 1:
                value = F.when(value > F.lit(last[name]).cast(df.schema[name].dataType), value)
            return F.min(value).cast("string")

        found = df.agg(*[smallest(c) for c in left]).first()
        last = dict(zip(left, found))
        rows += [(c, rank, v) for c, v in last.items() if v is not None]
    return local_rows(df.sparkSession, rows, "column string, rank int, value string")


def column_profile(df: DataFrame, facts: DataFrame | None = None, samples: int = SAMPLES) -> DataFrame:
    """Type, semantic type, distinct count, nulls and sample values, one row per column."""
    rows = F.nullif(F.col("n_rows"), F.lit(0)).cast("double")
    known, smallest = together(df.sparkSession, [lambda: _facts(df, facts), lambda: sample_values(df, samples)])
    profile = known.select(
        "column",
        "position",
        "data_type",
        semantic_type().alias("semantic_type"),
        "n_unique",
        F.coalesce(F.round(F.col("n_unique") / rows, 4), F.lit(0.0)).alias("uniqueness_ratio"),
        F.col("n_null").alias("null_count"),
        F.coalesce(F.round(F.col("n_null") / rows * 100, 2), F.lit(0.0)).alias("null_pct"),
    )
    shown = (
        smallest.groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("s"))
        .select("column", F.array_join("s.value", ", ").alias("sample_values"))
    )
    return profile.join(shown, "column", "left").orderBy("position")


def datetime_parse_rates(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Share of non-null values that are dates, for text and time columns: ``column, parse_rate, is_datetime``.

    All values count, not a sample of the first ones, so the answer does not depend on row order.
    """
    rate = F.col("datetime_rate")
    return (
        _facts(df, facts)
        .filter(F.col("kind").isin("string", "datetime"))
        .select(
            "column",
            "position",
            rate.alias("parse_rate"),
            ((F.col("kind") == "datetime") | (F.coalesce(rate, F.lit(0.0)) >= DATETIME_RATE)).alias("is_datetime"),
        )
        .orderBy("position")
    )


def lexical_type_counts(df: DataFrame) -> DataFrame:
    """How many values of each text column look like ``int, float, bool, date`` or ``text``.

    A Spark column has one storage type, so a mix of types can only show in the content of text columns. Only five
    counters per column and task are exchanged.
    """
    texts = string_columns(df)
    if not texts:
        return local_rows(df.sparkSession, [], "column string, lexical_type string, cnt bigint")
    cells = df.select(*[col(c) for c in texts]).unpivot([], [col(c) for c in texts], "column", "value")
    return (
        cells.filter("value IS NOT NULL")
        .groupBy("column", text.lexical_class(F.col("value")).alias("lexical_type"))
        .agg(F.count("*").alias("cnt"))
    )


def mixed_columns(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Text columns of which a good part, but not nearly all, is numeric: ``column, numeric_parseable_pct``."""
    rate = F.col("numeric_rate")
    return (
        _facts(df, facts)
        .filter((F.col("kind") == "string") & (rate > MIXED_LOW) & (rate < MIXED_HIGH))
        .select(
            "column",
            "position",
            F.lit("str (mixed numeric/text)").alias("types_found"),
            F.round(rate * 100, 1).alias("numeric_parseable_pct"),
        )
        .orderBy("position")
    )


def mixed_samples(df: DataFrame, facts: DataFrame | None = None, samples: int = SAMPLES) -> DataFrame:
    """What clashes in mixed columns: ``column, is_numeric, n_values, samples``, the smallest values of either kind.

    Values are counted before the exchange; each task and group keeps only the samples it may need.
    """
    names = [r["column"] for r in mixed_columns(df, facts).collect()]
    if not names:
        return local_rows(df.sparkSession, [], "column string, is_numeric boolean, n_values bigint, samples string")
    cells = df.select(*[col(c) for c in names]).unpivot([], [col(c) for c in names], "column", "value")
    kinds = cells.filter("value IS NOT NULL").select("column", text.looks_numeric(F.col("value")).alias("is_numeric"), "value")
    counted = kinds.groupBy("column", "is_numeric", "value").agg(F.count("*").alias("cnt"))
    totals = counted.groupBy("column", "is_numeric").agg(F.sum("cnt").alias("n_values"))
    smallest = Window.partitionBy("column", "is_numeric").orderBy("value")
    shown = counted.withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= samples)
    listed = F.array_sort(F.collect_list(F.struct("place", "value")))  # at most ``samples`` values
    shown = shown.groupBy("column", "is_numeric").agg(F.array_join(listed["value"], ", ").alias("samples"))
    return totals.join(shown, ["column", "is_numeric"])


def name_keyword(name: str, match: str = "substring") -> str | None:
    """The first target keyword in a column name. ``match='token'`` compares whole name parts instead."""
    lowered = name.lower().strip()
    parts = lowered.split("_")
    for keyword in TARGET_KEYWORDS:
        if keyword in (lowered if match == "substring" else parts):
            return keyword
    return None


def target_candidates(df: DataFrame, facts: DataFrame | None = None, match: str = "substring") -> DataFrame:
    """Columns that look like a prediction target, best first: ``column, score, reasons, n_unique, data_type``."""
    keywords = {c: name_keyword(c, match) for c in df.columns}
    hits = {c: k for c, k in keywords.items() if k}
    keyword = F.lit(None).cast("string")
    if hits:
        pairs = [part for c, k in hits.items() for part in (F.lit(c), F.lit(k))]
        keyword = F.try_element_at(F.create_map(*pairs), F.col("column"))
    unique = F.col("n_unique")
    minority = F.col("minority_cnt").cast("double") / F.col("n_nonnull") * 100
    binary = unique == 2
    skewed = binary & (minority < 30)
    low_cardinality = (unique > 2) & (unique <= 10) & (F.col("n_rows") > 50)
    score = (
        F.when(keyword.isNotNull(), 3).otherwise(0)
        + F.when(binary, 2).when(low_cardinality, 1).otherwise(0)
        + F.when(skewed, 1).otherwise(0)
    )
    reasons = F.concat_ws(
        "; ",
        F.when(keyword.isNotNull(), F.concat(F.lit("Name contains '"), keyword, F.lit("'"))),
        F.when(binary, F.lit("Binary column (2 unique values)")),
        F.when(skewed, F.format_string("Imbalanced (%.1f%% minority class)", minority)),
        F.when(low_cardinality, F.concat(F.lit("Low cardinality ("), unique.cast("string"), F.lit(" classes)"))),
    )
    return (
        _facts(df, facts)
        .select("column", "position", score.alias("score"), reasons.alias("reasons"), "n_unique", "data_type")
        .filter("score >= 2")
        .orderBy(F.desc("score"), "position")
    )


def primary_keys(
    df: DataFrame, facts: DataFrame | None = None, order_by: Sequence[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """Columns without nulls or repeats. With ``order_by``, an integer key is sequential when its values rise in the order of
    those columns. Without, it is when its values leave no hole, which says the same of row ids without relying on a row order.
    """
    # Hash values span all of 64 bits, so the width needs more.
    wide = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1
    keys = _facts(df, facts).filter(
        (F.col("n_rows") > 0) & (F.col("n_unique") == F.col("n_rows")) & (F.col("n_null") == 0)
    )
    if order_by:
        keys = collected(keys)
        integers = [r["column"] for r in keys.filter("is_integer").select("column").collect()]
        sequential = F.col("column").isin(list(rising_columns(df, integers, order_by, partitions)))
    else:
        sequential = F.coalesce(F.col("is_integer") & (wide == F.col("n_rows")), F.lit(False))
    fixed_length = (F.col("kind") == "string") & (F.col("min_len") == F.col("max_len")) & (F.col("n_rows") > 1)
    return keys.select(
        "column",
        "position",
        "data_type",
        sequential.alias("is_sequential"),
        "is_integer",
        F.when(sequential | fixed_length, "very_high").otherwise("high").alias("confidence"),
    ).orderBy("position")


def time_column_rows(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Time columns with the best one marked: a name hit first (in column order), else the most distinct values."""
    hits = [c for c in df.columns if any(k in c.lower() for k in TIME_KEYWORDS)]
    is_time = (F.col("kind") == "datetime") | (
        (F.col("kind") == "string") & (F.coalesce(F.col("datetime_rate"), F.lit(0.0)) >= DATETIME_RATE)
    )
    found = (
        _facts(df, facts)
        .filter(is_time)
        .select(
            "column",
            "position",
            "n_unique",
            F.col("column").isin(hits).alias("name_hit") if hits else F.lit(False).alias("name_hit"),
        )
    )
    choice = F.struct(
        ~F.col("name_hit"), F.when(F.col("name_hit"), F.lit(0)).otherwise(-F.col("n_unique")), F.col("position")
    )
    best = Window.orderBy(choice)  # over the few time columns of one table
    return found.withColumn("is_best", F.row_number().over(best) == 1).orderBy("position")


def best_time_column(df: DataFrame, facts: DataFrame | None = None) -> str | None:
    row = time_column_rows(df, facts).filter("is_best").first()
    return row["column"] if row else None


def temporal_span(df: DataFrame, column: str) -> DataFrame:
    """Start, end, whole days between them and the number of parsed records; no row below two records."""
    times = parsed_times(df, column)
    span = times.agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("ts").alias("n_records")
    )
    micros = F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts"))
    return span.filter("n_records > 1").select(
        F.lit(column).alias("column"),
        "start_ts",
        "end_ts",
        F.floor(micros / F.lit(86_400_000_000.0)).cast("bigint").alias("duration_days"),
        "n_records",
    )


def time_frequency(df: DataFrame, column: str) -> DataFrame:
    """Median gap between consecutive records and its name; both NULL below three records."""
    gap = median_gap(df, column).select(
        F.lit(column).alias("column"), "n_records", F.col("median_gap_us").alias("median_gap_us")
    )
    return gap.withColumn("frequency", frequency_label(F.col("median_gap_us")))


def column_categories(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``semantic_type, n_columns, columns``: one row per semantic type, also for those without columns."""
    every = local_rows(df.sparkSession, [(t,) for t in SEMANTIC_TYPES], "semantic_type string")
    grouped = (
        semantic_types(df, facts)
        .groupBy("semantic_type")
        .agg(F.array_sort(F.collect_list(F.struct("position", "column"))).alias("found"))
    )
    return every.join(grouped, "semantic_type", "left").select(
        "semantic_type",
        F.coalesce(F.size("found"), F.lit(0)).cast("bigint").alias("n_columns"),
        F.coalesce(F.array_join("found.column", ", "), F.lit("")).alias("columns"),
    )


def columns_of_type(df: DataFrame, wanted: str, facts: DataFrame | None = None) -> list[str]:
    return [r["column"] for r in semantic_types(df, facts).collect() if r["semantic_type"] == wanted]


def dataset_shape(df: DataFrame) -> DataFrame:
    """``rows, cols`` and the one-line description."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    line = F.concat(
        F.lit("This dataset has "),
        F.format_number(F.col("rows"), 0),
        F.lit(f" rows and {len(df.columns)} columns."),
    )
    return rows.select("rows", F.lit(len(df.columns)).cast("bigint").alias("cols"), line.alias("description"))


def basic_schema(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``column, data_type, non_null_count, unique_values``."""
    return (
        _facts(df, facts)
        .orderBy("position")
        .select(
            "column",
            "data_type",
            F.col("n_nonnull").alias("non_null_count"),
            F.col("n_unique").alias("unique_values"),
        )
    )


def column_type_split(df: DataFrame, facts: DataFrame | None = None, max_classes: int = 30) -> DataFrame:
    """Numeric columns, and text columns with fewer than ``max_classes`` values: ``column, position, role``."""
    is_class = (F.col("kind") == "string") & (F.col("n_unique") < max_classes)
    return (
        _facts(df, facts)
        .select(
            "column",
            "position",
            F.when(F.col("kind") == "numeric", "numeric").when(is_class, "categorical").alias("role"),
        )
        .filter("role IS NOT NULL")
        .orderBy("position")
    )


def schema_display(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The column profile as formatted text, ready to show."""
    return (
        column_profile(df, facts)
        .orderBy("position")
        .select(
            "column",
            F.col("data_type").alias("storage_type"),
            F.initcap("semantic_type").alias("semantic_type"),
            F.col("n_unique").alias("unique_values"),
            F.format_string("%.1f%%", F.col("uniqueness_ratio") * 100).alias("uniqueness_pct"),
            F.col("null_count").alias("nulls"),
            F.format_string("%.2f%%", F.col("null_pct")).alias("null_pct"),
            "sample_values",
        )
    )


def _nothing() -> None:
    return None


def schema_report(df: DataFrame, match: str = "substring") -> dict[str, DataFrame]:
    """All schema reports of a table over one set of facts."""
    facts = column_facts(df)
    best = best_time_column(df, facts)
    span, frequency = together(
        df.sparkSession,
        [lambda: collected(temporal_span(df, best)), lambda: time_frequency(df, best)] if best else [_nothing] * 2,
    )
    report = {
        "shape": dataset_shape(df),
        "facts": facts,
        "column_profile": column_profile(df, facts),
        "mixed_columns": mixed_columns(df, facts),
        "target_candidates": collected(target_candidates(df, facts, match)),
        "primary_keys": primary_keys(df, facts),
        "time_columns": collected(time_column_rows(df, facts)),
        "column_categories": column_categories(df, facts),
    }
    if best:
        report["temporal_span"], report["time_frequency"] = span, frequency
    return report


