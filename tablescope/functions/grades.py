"""Threshold scales that turn a number into a word. All limits are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _below(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    scale = F.when(value < steps[0][0], steps[0][1])
    for limit, word in steps[1:]:
        scale = scale.when(value < limit, word)
    return scale.otherwise(rest)


def _at_least(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    scale = F.when(value >= steps[0][0], steps[0][1])
    for limit, word in steps[1:]:
        scale = scale.when(value >= limit, word)
    return scale.otherwise(rest)


def missing_severity(pct: Column) -> Column:
    return F.when(pct == 0, "none").otherwise(_below(pct, [(5, "low"), (15, "moderate"), (40, "high")], "critical"))


def outlier_severity(pct: Column) -> Column:
    return F.when(pct == 0, "none").otherwise(_below(pct, [(2, "low"), (5, "moderate"), (15, "high")], "extreme"))


def imbalance_severity(ratio: Column) -> Column:
    return _below(ratio, [(1.5, "balanced"), (3, "mild"), (10, "moderate"), (50, "severe")], "extreme")


def imbalance_advice(severity: Column, is_target: Column, column: Column) -> Column:
    quoted = F.concat(F.lit("'"), column, F.lit("'"))
    who = F.concat(F.when(is_target, "Target column ").otherwise("Column "), quoted)
    return (
        F.when(severity == "balanced", F.concat(quoted, F.lit(" has well-balanced class distribution.")))
        .when(
            severity == "mild",
            F.concat(who, F.lit(" shows mild imbalance. Standard ML models should handle this.")),
        )
        .when(
            severity == "moderate",
            F.concat(who, F.lit(" has moderate imbalance. Consider stratified sampling or class weights.")),
        )
        .when(
            severity == "severe",
            F.concat(who, F.lit(" is severely imbalanced. Use SMOTE, class weights, or specialized techniques.")),
        )
        .otherwise(
            F.concat(
                who,
                F.lit(
                    " has extreme imbalance. Anomaly detection approach may be more appropriate than classification."
                ),
            )
        )
    )


def correlation_strength(r: Column) -> Column:
    return _at_least(
        F.abs(r), [(0.9, "very strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak")], "negligible"
    )


def quality_grade(total: Column) -> Column:
    return _at_least(total, [(90, "A"), (75, "B"), (60, "C"), (40, "D")], "F")


def gauge_band(total: Column) -> Column:
    return _below(total, [(40, "0-40"), (60, "40-60"), (75, "60-75")], "75-100")


def distribution_type(skew: Column, kurt: Column, is_normal: Column) -> Column:
    return (
        F.when((F.abs(skew) < 0.5) & is_normal, "normal")
        .when(F.abs(skew) < 0.5, "approximately symmetric")
        .when(skew > 2, "highly right-skewed")
        .when(skew > 0.5, "right-skewed")
        .when(skew < -2, "highly left-skewed")
        .when(skew < -0.5, "left-skewed")
        .when(kurt > 5, "heavy-tailed")
        .otherwise("approximately symmetric")
    )


def frequency_label(median_gap_us: Column) -> Column:
    """Name of a sampling frequency, from the median gap in microseconds."""
    days = F.floor(median_gap_us / F.lit(86_400_000_000.0)).cast("bigint")
    hours = median_gap_us / F.lit(3_600_000_000.0)
    return (
        F.when(median_gap_us.isNull(), F.lit(None).cast("string"))
        .when((days == 0) & (hours < 1), "sub-hourly")
        .when((days == 0) & (hours <= 1.5), "hourly")
        .when(days == 0, "intra-day")
        .when(days == 1, "daily")
        .when(days.between(6, 8), "weekly")
        .when(days.between(13, 16), "bi-weekly")
        .when(days.between(27, 33), "monthly")
        .when(days.between(85, 95), "quarterly")
        .when(days.between(360, 370), "yearly")
        .otherwise(F.concat(F.lit("~"), days.cast("string"), F.lit("-day intervals")))
    )
