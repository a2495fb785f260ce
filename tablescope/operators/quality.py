"""How healthy the raw table is: missing values, duplicates, formats, outliers, class balance and one score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescope.functions import grades
from tablescope.functions.text import case_key, has_edge_space, trimmed
from tablescope.operators.schema import target_candidates
from tablescope.plans.columns import (
    col,
    collected,
    flat_columns,
    local_rows,
    nan_to_null,
    numeric_columns,
    per_column,
    schema_rows,
    string_columns,
)
from tablescope.plans.duplicates import duplicated_rows
from tablescope.plans.passes import column_facts, text_key, value_counts
from tablescope.plans.quantiles import exact_quantiles
from tablescope.plans.together import together

IQR_MULTIPLIER = 1.5
MIN_VALUES_FOR_OUTLIERS = 10
TOP = 5
MAX_CLASSES = 15


def _pct(part: Column, whole: Column, digits: int) -> Column:
    share = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.coalesce(F.round(share, digits), F.lit(0.0))


def _positions(df: DataFrame) -> DataFrame:
    return schema_rows(df).select("column", "position")


def missing_values(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``column, position, missing_count, missing_pct, severity``, most missing first."""
    if facts is None:
        df = nan_to_null(df)
        counts = per_column(
            df,
            df.columns,
            lambda c: {"n_rows": F.count(F.lit(1)), "missing_count": F.count_if(col(c).isNull())},
            "n_rows bigint, missing_count bigint",
        ).join(_positions(df), "column")
    else:
        counts = facts.select("column", "position", "n_rows", F.col("n_null").alias("missing_count"))
    pct = _pct(F.col("missing_count"), F.col("n_rows"), 2)
    return (
        counts
        .select("column", "position", "missing_count", pct.alias("missing_pct"))
        .withColumn("severity", grades.missing_severity(F.col("missing_pct")))
        .orderBy(F.desc("missing_count"), "position")
    )


def _row_totals(df: DataFrame) -> DataFrame:
    """One row: row count, missing cells and rows with at least one missing cell."""
    gaps = [col(c).isNull() for c in df.columns]
    missing = sum((g.cast("bigint") for g in gaps[1:]), gaps[0].cast("bigint"))
    per_row = df.select(missing.alias("gaps"))
    return per_row.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("total_missing"),
        F.count_if(F.col("gaps") > 0).alias("rows_with_any_missing"),
    )


def _complete_totals(df: DataFrame) -> DataFrame:
    return local_rows(
        df.sparkSession, [(df.count(), 0, 0)], "n_rows bigint, total_missing bigint, rows_with_any_missing bigint"
    )


def missing_summary(df: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """One row of totals with a sentence on where the gaps are."""
    df = nan_to_null(df)
    missing = collected(missing_values(df)) if missing is None else missing
    names = [r["column"] for r in missing.orderBy(F.desc("missing_count"), "position").collect() if r["missing_count"]]
    if not names:
        pattern = "No missing values detected — dataset is fully complete."
    elif len(names) <= 3:
        pattern = f"Missing values concentrated in {len(names)} column(s): {', '.join(names)}."
    else:
        pattern = (
            f"Missing values spread across {len(names)} columns — may indicate systemic data collection issues."
        )
    cells = F.col("n_rows") * len(df.columns)
    totals = _row_totals(df) if names else _complete_totals(df)
    return totals.select(
        "total_missing",
        cells.alias("total_cells"),
        _pct(F.col("total_missing"), cells, 2).alias("overall_pct"),
        "rows_with_any_missing",
        (F.col("n_rows") - F.col("rows_with_any_missing")).alias("rows_complete"),
        F.lit(pattern).alias("pattern_summary"),
    )


def duplicate_rows(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row: ``n_rows, exact_duplicates, exact_pct, recommendation``.

    A column that the facts show to be a key rules duplicates out without another pass.
    """
    is_key = (F.col("n_unique") == F.col("n_rows")) & (F.col("n_null") == 0)
    keyed = facts is not None and facts.filter(is_key).first() is not None
    count = 0 if keyed else duplicated_rows(df)
    found = local_rows(df.sparkSession, [(df.count(), count)], "n_rows bigint, exact_duplicates bigint")
    found = found.withColumn("exact_pct", _pct(F.col("exact_duplicates"), F.col("n_rows"), 2))
    share = F.concat(
        F.col("exact_duplicates").cast("string"), F.lit(" rows ("), F.col("exact_pct").cast("string"), F.lit("%). ")
    )
    advice = (
        F.when(F.col("exact_duplicates") == 0, "No exact duplicate rows found. Data appears clean.")
        .when(F.col("exact_pct") < 1, F.concat(F.lit("Minor duplication: "), share, F.lit("Likely safe to deduplicate.")))
        .when(
            F.col("exact_pct") < 10,
            F.concat(
                F.lit("Moderate duplication: "),
                share,
                F.lit("Review before removal — could be valid repeated records."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Heavy duplication: "), share, F.lit("Investigate data pipeline for repeat ingestion.")
            )
        )
    )
    return found.withColumn("recommendation", advice)


def duplicate_subsets(df: DataFrame, facts: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """Non-numeric columns by rows that repeat an earlier value (a null counts as a value), all or the ``top`` ones.

    The repeats follow from the distinct counts, so no column is grouped again.
    """
    facts = column_facts(df) if facts is None else facts
    candidates = facts.filter(~F.col("kind").isin("numeric", "other"))
    values = F.col("n_unique") + (F.col("n_null") > 0).cast("bigint")
    found = (
        candidates.select("column", "position", (F.col("n_rows") - values).alias("duplicates"), "n_rows")
        .filter("duplicates > 0")
        .orderBy(F.desc("duplicates"), "position")
    )
    found = found if top is None else found.limit(top)
    return found.select("column", "duplicates", _pct(F.col("duplicates"), F.col("n_rows"), 1).alias("pct"))


def format_whitespace(df: DataFrame) -> DataFrame:
    """``column, affected_count`` of text columns with white space at an end of some value."""
    counts = per_column(
        df, string_columns(df), lambda c: {"affected_count": F.count_if(has_edge_space(col(c)))}, "affected_count bigint"
    )
    return counts.filter("affected_count > 0")


def format_empty_strings(df: DataFrame) -> DataFrame:
    """``column, affected_count`` of text columns with values that are empty once stripped."""
    counts = per_column(
        df, string_columns(df), lambda c: {"affected_count": F.count_if(trimmed(col(c)) == "")}, "affected_count bigint"
    )
    return counts.filter("affected_count > 0")


def _cells_with_case_key(df: DataFrame) -> DataFrame:
    columns = string_columns(df)
    if not columns:
        return local_rows(df.sparkSession, [], "column string, value string, canonical string")
    cells = df.select(*[col(c) for c in columns]).unpivot([], [col(c) for c in columns], "column", "value")
    return cells.filter("value IS NOT NULL").withColumn("canonical", case_key(F.col("value")))


def _case_groups(df: DataFrame) -> DataFrame:
    """``column, group, total``: groups of at least two spellings; ``group`` stands for the canonical text."""
    keyed = _cells_with_case_key(df).select(
        "column", text_key(F.col("canonical")).alias("group"), text_key(F.col("value")).alias("spelling")
    )
    spellings = keyed.groupBy("column", "group", "spelling").agg(F.count("*").alias("cnt"))
    return (
        spellings.groupBy("column", "group")
        .agg(F.count("*").alias("n_variants"), F.sum("cnt").alias("total"))
        .filter("n_variants > 1")
    )


def format_case_variants(df: DataFrame, top: int = TOP) -> DataFrame:
    """Values of a column that differ only by case or outer white space: the five largest groups per column, one
    row per variant: ``column, canonical, variant, cnt, total``.

    The limit per column is applied in every task before the exchange. The at most five groups per column are then
    broadcast to pick the rows whose spellings are listed.
    """
    largest = Window.partitionBy("column").orderBy(F.desc("total"), "group")
    kept = _case_groups(df).withColumn("place", F.row_number().over(largest)).filter(F.col("place") <= top)
    cells = _cells_with_case_key(df).withColumn("group", text_key(F.col("canonical")))
    return (
        cells.join(F.broadcast(kept.select("column", "group", "total")), ["column", "group"])
        .groupBy("column", "canonical", F.col("value").alias("variant"), "total")
        .agg(F.count("*").alias("cnt"))
    )


def format_issues(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row per text column with at least one kind of issue: ``column, issue_count, issues``."""
    if facts is None:
        flags = per_column(
            df,
            string_columns(df),
            lambda c: {
                "edge_space": F.count_if(has_edge_space(col(c))),
                "empty": F.count_if(trimmed(col(c)) == ""),
            },
            "edge_space bigint, empty bigint",
        )
    else:
        flags = facts.filter("kind = 'string'").select(
            "column", F.col("n_edge_space").alias("edge_space"), F.col("n_empty").alias("empty")
        )
    mixed = _case_groups(df).groupBy("column").agg(F.count("*").alias("case_groups"))
    found = flags.join(mixed, "column", "left")
    issues = F.array_compact(
        F.array(
            F.when(F.col("edge_space") > 0, F.lit("whitespace")),
            F.when(F.col("case_groups") > 0, F.lit("mixed_case")),
            F.when(F.col("empty") > 0, F.lit("empty_strings")),
        )
    )
    return (
        found.join(_positions(df), "column")
        .select(
            "column",
            "position",
            F.size(issues).cast("bigint").alias("issue_count"),
            F.array_join(issues, ", ").alias("issues"),
        )
        .filter("issue_count > 0")
        .orderBy("position")
    )


def outlier_bounds(
    df: DataFrame, multiplier: float = IQR_MULTIPLIER, facts: DataFrame | None = None
) -> dict[str, tuple[float, float]]:
    """Lower and upper bound per numeric column with at least ten values and a spread between its quartiles."""
    df = nan_to_null(df)
    columns = numeric_columns(df)
    if facts is None:
        counts = per_column(df, columns, lambda c: {"n": F.count(col(c))}, "n bigint").collect()
    else:
        counts = facts.filter("kind = 'numeric'").select("column", F.col("n_nonnull").alias("n")).collect()
    enough = [r["column"] for r in counts if r["n"] >= MIN_VALUES_FOR_OUTLIERS]
    quartiles = exact_quantiles(df, enough, [0.25, 0.75], ["q1", "q3"])
    bounds = {}
    for r in quartiles.collect():
        spread = r["q3"] - r["q1"]
        if spread != 0:
            bounds[r["column"]] = (r["q1"] - multiplier * spread, r["q3"] + multiplier * spread)
    return {c: bounds[c] for c in columns if c in bounds}


def iqr_outliers(
    df: DataFrame,
    multiplier: float = IQR_MULTIPLIER,
    digits: int = 4,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Outliers beyond the quartile fences per numeric column, most first."""
    df = nan_to_null(df)
    bounds = outlier_bounds(df, multiplier, facts)

    def measures(name: str) -> dict[str, Column]:
        value, (low, high) = col(name).cast("double"), bounds[name]
        return {
            "n": F.count(value),
            "outlier_count": F.count_if((value < F.lit(low)) | (value > F.lit(high))),
            "min_val": F.min(value),
            "max_val": F.max(value),
            "lower_bound": F.lit(low),
            "upper_bound": F.lit(high),
        }

    found = per_column(
        df,
        list(bounds),
        measures,
        "n bigint, outlier_count bigint, min_val double, max_val double, lower_bound double, upper_bound double",
    )
    pct = _pct(F.col("outlier_count"), F.col("n"), 2)
    return (
        found.join(_positions(df), "column")
        .select(
            "column",
            "position",
            "outlier_count",
            pct.alias("outlier_pct"),
            *[F.round(c, digits).alias(c) for c in ("lower_bound", "upper_bound", "min_val", "max_val")],
        )
        .withColumn("severity", grades.outlier_severity(F.col("outlier_pct")))
        .orderBy(F.desc("outlier_count"), "position")
    )


def outlier_summary(df: DataFrame, outliers: DataFrame | None = None) -> DataFrame:
    """One row: ``total_outliers, columns_with_outliers, summary``."""
    outliers = iqr_outliers(df) if outliers is None else outliers
    rows = [r for r in outliers.orderBy(F.desc("outlier_count"), "position").collect() if r["outlier_count"]]
    total = sum(r["outlier_count"] for r in rows)
    if not rows:
        summary = "No significant outliers detected across numeric columns."
    elif len(rows) <= 2:
        names = ", ".join(f"{r['column']} ({r['outlier_count']})" for r in rows)
        summary = f"Outliers found in {len(rows)} column(s): {names}."
    else:
        summary = f"Outliers detected in {len(rows)} columns. Total outlier data points: {total}."
    return local_rows(
        df.sparkSession,
        [(total, len(rows), summary)],
        "total_outliers bigint, columns_with_outliers bigint, summary string",
    )


def outlier_samples(
    df: DataFrame, multiplier: float = IQR_MULTIPLIER, samples: int = TOP, digits: int = 4
) -> DataFrame:
    """The most extreme outliers of each column: ``column, rank, value``. Free of row order; equal values repeat.

    Values inside the fences are dropped in the scan, and the limit per column is applied before the exchange.
    """
    df = nan_to_null(df)
    bounds = outlier_bounds(df, multiplier)
    if not bounds:
        return local_rows(df.sparkSession, [], "column string, rank int, value double")
    cells = []
    for name, (low, high) in bounds.items():
        value = col(name).cast("double")
        distance = F.greatest(F.lit(low) - value, value - F.lit(high))
        cells.append(F.when(distance > 0, F.struct(distance.alias("distance"), value.alias("v"))).alias(name))
    far = (
        df.select(*cells)
        .unpivot([], [col(c) for c in bounds], "column", "cell")
        .filter("cell IS NOT NULL")
        .select("column", "cell.distance", F.col("cell.v").alias("value"))
    )
    extreme = Window.partitionBy("column").orderBy(F.desc("distance"), "value")
    return (
        far.withColumn("rank", F.row_number().over(extreme))
        .filter(F.col("rank") <= samples)
        .select("column", "rank", F.round("value", digits).alias("value"))
    )


def class_imbalance(
    df: DataFrame, targets: Sequence[str] | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """Balance of the classes of target candidates and of every column with 2 to 15 values, targets first.

    ``targets`` are the target columns; by default the candidates that ``target_candidates`` finds.
    """
    facts = column_facts(df) if facts is None else facts
    if targets is None:
        targets = [r["column"] for r in target_candidates(df, facts).collect()]
    is_target = F.col("column").isin(list(targets)) if targets else F.lit(False)
    total = F.col("n_nonnull")
    ratio = F.round(F.col("majority_cnt") / F.col("minority_cnt").cast("double"), 2)
    found = (
        facts.filter((F.col("kind") != "other") & (F.col("n_unique") >= 2))
        .filter(is_target | (F.col("n_unique") <= MAX_CLASSES))
        .select(
            "column",
            "position",
            F.col("n_unique").alias("n_classes"),
            F.col("majority").alias("majority_class"),
            _pct(F.col("majority_cnt"), total, 1).alias("majority_pct"),
            F.col("minority").alias("minority_class"),
            _pct(F.col("minority_cnt"), total, 1).alias("minority_pct"),
            ratio.alias("imbalance_ratio"),
            is_target.alias("is_target_column"),
        )
    )
    found = found.withColumn("severity", grades.imbalance_severity(F.col("imbalance_ratio")))
    advice = grades.imbalance_advice(F.col("severity"), F.col("is_target_column"), F.col("column"))
    return found.withColumn("recommendation", advice).orderBy(
        F.desc("is_target_column"), F.desc("imbalance_ratio"), "position"
    )


def class_distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, class, cnt, pct`` of the columns that ``class_imbalance`` reports, one row per class.

    The totals come from a second aggregate with one row per column, not from a window over all classes of a
    column, since a target candidate may have any number of classes.
    """
    df = nan_to_null(df)
    if columns is None:
        columns = [r["column"] for r in class_imbalance(df).collect()]
    counted = value_counts(df, list(columns))
    totals = counted.groupBy("column").agg(F.sum("cnt").alias("total"))
    return counted.join(F.broadcast(totals), "column").select(
        "column", F.col("value").alias("class"), "cnt", _pct(F.col("cnt"), F.col("total"), 1).alias("pct")
    )


def quality_score(
    df: DataFrame,
    missing: DataFrame | None = None,
    duplicates: DataFrame | None = None,
    issues: DataFrame | None = None,
    outliers: DataFrame | None = None,
) -> DataFrame:
    """One row: ``completeness, uniqueness, consistency, validity, total, grade`` (25 points each, 100 in all).

    The four inputs are short reports; each is reduced to named numbers and one aggregate puts them side by side.
    """
    totals, copies, formats, fences = together(
        df.sparkSession,
        [
            lambda: collected(missing_summary(df)) if missing is None else missing,
            lambda: collected(duplicate_rows(df)) if duplicates is None else duplicates,
            lambda: collected(format_issues(df)) if issues is None else issues,
            lambda: collected(iqr_outliers(df)) if outliers is None else outliers,
        ],
    )
    mean_outliers = F.avg(F.when(F.col("outlier_count") > 0, F.col("outlier_pct")))
    parts = (
        totals.select(F.lit("missing").alias("part"), F.col("overall_pct").alias("number"))
        .unionByName(copies.select(F.lit("duplicates").alias("part"), F.col("exact_pct").alias("number")))
        .unionByName(
            formats.agg(F.sum("issue_count").cast("double").alias("number")).withColumn("part", F.lit("issues"))
        )
        .unionByName(fences.agg(mean_outliers.alias("number")).withColumn("part", F.lit("outliers")))
    )

    def points(part: str, weight: float) -> Column:
        number = F.coalesce(F.max(F.when(F.col("part") == part, F.col("number"))), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.lit(25.0) - number * weight)

    dims = parts.agg(
        points("missing", 0.5).alias("completeness"),
        points("duplicates", 0.5).alias("uniqueness"),
        points("issues", 2.0).alias("consistency"),
        points("outliers", 1.5).alias("validity"),
    )
    names = ["completeness", "uniqueness", "consistency", "validity"]
    total = F.round(sum((F.col(n) for n in names[1:]), F.col(names[0])), 1)
    return dims.withColumn("total", total).select(
        *[F.round(n, 1).alias(n) for n in names], "total", grades.quality_grade(F.col("total")).alias("grade")
    )


def missing_display(df: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """Columns with gaps as formatted text."""
    missing = missing_values(df) if missing is None else missing
    return (
        missing.filter("missing_count > 0")
        .orderBy(F.desc("missing_count"), "position")
        .select(
            "column",
            F.col("missing_count").alias("missing"),
            F.format_string("%.2f%%", F.col("missing_pct")).alias("pct_missing"),
            F.initcap("severity").alias("severity"),
        )
    )


def outlier_display(df: DataFrame, outliers: DataFrame | None = None) -> DataFrame:
    """Columns with outliers as formatted text."""
    outliers = iqr_outliers(df) if outliers is None else outliers
    return (
        outliers.filter("outlier_count > 0")
        .orderBy(F.desc("outlier_count"), "position")
        .select(
            "column",
            F.col("outlier_count").alias("outliers"),
            F.format_string("%.2f%%", F.col("outlier_pct")).alias("pct_outlier"),
            "lower_bound",
            "upper_bound",
            F.initcap("severity").alias("severity"),
        )
    )


def quality_report(
    df: DataFrame, targets: Sequence[str] | None = None, facts: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All quality reports of a raw table over one set of facts; the short ones are kept as local rows."""
    facts = column_facts(df) if facts is None else facts
    missing = collected(missing_values(df, facts))
    totals, duplicates, issues, outliers, imbalance, extremes = together(
        df.sparkSession,
        [
            lambda: collected(missing_summary(df, missing)),
            lambda: collected(duplicate_rows(df, facts)),
            lambda: collected(format_issues(df, facts)),
            lambda: collected(iqr_outliers(df, facts=facts)),
            lambda: collected(class_imbalance(df, targets, facts)),
            lambda: outlier_samples(df),
        ],
    )
    return {
        "missing_values": missing,
        "missing_summary": totals,
        "duplicate_rows": duplicates,
        "duplicate_subsets": duplicate_subsets(df, facts),
        "format_issues": issues,
        "iqr_outliers": outliers,
        "outlier_summary": outlier_summary(df, outliers),
        "class_imbalance": imbalance,
        "quality_score": collected(quality_score(df, totals, duplicates, issues, outliers)),
        # Details, computed when they are read.
        "outlier_samples": extremes,
        "class_distribution": class_distribution(df, [r["column"] for r in imbalance.select("column").collect()]),
        "format_whitespace": format_whitespace(df),
        "format_empty_strings": format_empty_strings(df),
        "format_case_variants": format_case_variants(df),
    }
