"""Statistical profile of the clean table: moments, normality, correlation."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions import grades, shape
from tablescope.plans.columns import col, collected, local_rows, nan_to_null, numeric_columns, per_column, schema_rows
from tablescope.plans.passes import moments
from tablescope.plans.quantiles import exact_quantiles

# Share of a mean square below which a variance taken from sums is not trusted; such pairs are aggregated one by one.
LEAST_VARIANCE = 1e-6
PAIRS_PER_AGGREGATE = 24
TOP_PAIRS = 10
DISPLAY_PAIRS = 15
STRONG = 0.7


def _shaped(df: DataFrame) -> DataFrame:
    """Moments with the sample skewness and kurtosis, one row per numeric column."""
    n, std = F.col("n"), F.col("std")
    return (
        moments(df, numeric_columns(df))
        .join(schema_rows(df).select("column", "position"), "column")
        .withColumn("skew", shape.sample_skewness(n, F.col("g1"), std))
        .withColumn("kurt", shape.sample_kurtosis(n, F.col("g2"), std))
    )


def column_shapes(df: DataFrame) -> DataFrame:
    """Moments and quartiles per numeric column, unrounded; the base of the reports below."""
    df = nan_to_null(df)
    quartiles = exact_quantiles(df, numeric_columns(df), [0.25, 0.5, 0.75], ["q25", "median", "q75"])
    return _shaped(df).join(quartiles, "column")


def descriptive_stats(df: DataFrame, shapes: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """Count, mean, deviation, quartiles, range, skewness, excess kurtosis and coefficient of variation of every
    numeric column with at least three values."""
    shapes = column_shapes(df) if shapes is None else shapes
    cv = F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(F.round(F.col("std") / F.col("mean") * 100, 2))
    rounded = {
        "mean": "mean", "std": "std", "min": "low", "q25": "q25", "median": "median", "q75": "q75", "max": "high",
        "skewness": "skew", "kurtosis": "kurt",
    }
    return (
        shapes.filter("n >= 3")
        .orderBy("position")
        .select(
            "column",
            F.col("n").alias("count"),
            *[F.round(source, digits).alias(name) for name, source in rounded.items()],
            cv.alias("cv_pct"),
        )
    )


def skewed_columns(df: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Columns with an absolute skewness over 1, with direction and advice."""
    shapes = _shaped(nan_to_null(df)) if shapes is None else shapes
    advice = F.concat(F.lit("Consider log or sqrt transform for '"), F.col("column"), F.lit("'"))
    return (
        shapes.filter((F.col("n") >= 3) & (F.abs("skew") > 1))
        .orderBy("position")
        .select(
            "column",
            F.round("skew", 4).alias("skewness"),
            F.when(F.col("skew") > 0, "right").otherwise("left").alias("direction"),
            advice.alias("suggestion"),
        )
    )


def high_kurtosis(df: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Columns with an absolute excess kurtosis over 3."""
    shapes = _shaped(nan_to_null(df)) if shapes is None else shapes
    tails = F.when(F.col("kurt") > 0, "leptokurtic (heavy tails)").otherwise("platykurtic (light tails)")
    return (
        shapes.filter((F.col("n") >= 3) & (F.abs("kurt") > 3))
        .orderBy("position")
        .select("column", F.round("kurt", 4).alias("kurtosis"), tails.alias("type"))
    )


def normality_test(df: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """K-squared test of every numeric column with at least twenty values: ``p_value`` and ``is_normal``.

    A constant column has no shape to test: its p-value is NULL and it is not normal.
    """
    shapes = _shaped(nan_to_null(df)) if shapes is None else shapes
    p = F.when(F.col("std") > 0, shape.normality_p(F.col("n"), F.col("g1"), F.col("g2")))
    return (
        shapes.filter("n >= 20")
        .withColumn("p", p)
        .orderBy("position")
        .select(
            "column",
            "position",
            F.col("n").alias("n_samples"),
            F.round("skew", 4).alias("skewness"),
            F.round("kurt", 4).alias("kurtosis"),
            F.lit("D'Agostino-Pearson").alias("normality_test"),
            F.round("p", 6).alias("p_value"),
            F.coalesce(F.col("p") > 0.05, F.lit(False)).alias("is_normal"),
            F.col("skew").alias("_skew"),
            F.col("kurt").alias("_kurt"),
        )
        .withColumn(
            "distribution_type", grades.distribution_type(F.col("_skew"), F.col("_kurt"), F.col("is_normal"))
        )
        .drop("_skew", "_kurt")
    )


def distribution_types(df: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """``column, is_normal, distribution_type``."""
    return normality_test(df, shapes).select("column", "is_normal", "distribution_type")


def gram_matrix(df: DataFrame, scales: dict[str, tuple[float, float]]) -> np.ndarray:
    """Sums over all rows of the products of any two of: presence, value and squared value of each column.

    Values are shifted and scaled by ``scales`` (mean and deviation) first, and a missing one is 0, so the products
    of two columns only count rows where both are present. A task multiplies its batches as matrices and sends one
    row per line of the matrix; lines of all tasks are added up by their elements.
    """
    names = list(scales)
    values = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    shift = np.array([scales[c][0] for c in names])
    width = np.array([scales[c][1] or 1.0 for c in names])

    def multiplied(batches):
        total = np.zeros((3 * len(shift), 3 * len(shift)))
        for batch in batches:
            # A missing value arrives as NaN.
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            present = ~np.isnan(x)
            x = np.where(present, (x - shift) / width, 0.0)
            whole = np.hstack([present, x, x * x])
            total += whole.T @ whole
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["line", "sums"]
        )

    parts = values.mapInArrow(multiplied, "line int, sums array<double>")
    cells = parts.select("line", F.posexplode("sums").alias("place", "part")).groupBy("line", "place").agg(F.sum("part"))
    matrix = np.zeros((3 * len(names), 3 * len(names)))
    for line, place, total in cells.collect():
        matrix[line, place] = total
    return matrix


def pairwise_r(
    matrix: np.ndarray, names: list[str], pairs: list[tuple[str, str]]
) -> tuple[dict[tuple[str, str], float], list[tuple[str, str]]]:
    """Pearson r of pairs from their Gram matrix, and the pairs it cannot settle: those where a column hardly varies on
    the rows with both values, so that its variance is lost in rounding."""
    k, at = len(names), {c: i for i, c in enumerate(names)}
    found, doubtful = {}, []
    for a, b in pairs:
        i, j = at[a], at[b]
        n = matrix[i, j]
        if n < 2:
            continue
        mean_a, mean_b = matrix[k + i, j] / n, matrix[i, k + j] / n
        square_a, square_b = matrix[2 * k + i, j] / n, matrix[i, 2 * k + j] / n
        var_a, var_b = square_a - mean_a**2, square_b - mean_b**2
        if var_a > LEAST_VARIANCE * square_a and var_b > LEAST_VARIANCE * square_b:
            r = (matrix[k + i, k + j] / n - mean_a * mean_b) / np.sqrt(var_a * var_b)
            found[(a, b)] = float(np.clip(r, -1.0, 1.0))
        else:
            doubtful.append((a, b))
    return found, doubtful


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson r of every pair of numeric columns, unrounded: ``col1, col2, r``, in column order.

    Columns without gaps go through one vector aggregate, whose cost does not grow with generated code. Pairs with
    a column that has gaps are taken over the rows where both are present, all of them in one further pass
    (``gram_matrix``). Pairs without an r (a column that is constant there) are left out.
    """
    df = nan_to_null(df)
    columns = numeric_columns(df) if columns is None else columns
    spark = df.sparkSession
    schema = "col1 string, col2 string, r double, position int"
    if len(columns) < 2:
        return local_rows(spark, [], schema)
    order = {pair: i for i, pair in enumerate(combinations(columns, 2))}
    checks = per_column(
        df,
        columns,
        lambda c: {
            "gaps": F.count_if(col(c).isNull()),
            "n": F.count(col(c)),
            "mean": F.avg(col(c).cast("double")),
            "std": F.stddev_samp(col(c).cast("double")),
        },
        "gaps bigint, n bigint, mean double, std double",
    ).collect()
    full = [r["column"] for r in checks if not r["gaps"] and r["n"] > 1]
    empty = {r["column"] for r in checks if r["n"] < 2}
    found: dict[tuple[str, str], float] = {}
    if len(full) > 1:
        safe = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(full)])
        vectors = VectorAssembler(inputCols=safe.columns, outputCol="v").transform(safe).select("v")
        matrix = Correlation.corr(vectors, "v").first()[0].toArray()
        for (i, a), (j, b) in combinations(enumerate(full), 2):
            found[(a, b)] = float(matrix[i][j])
    whole = set(full)
    rest = [p for p in order if not (p[0] in whole and p[1] in whole) and not empty & set(p)]
    if rest:
        scales = {r["column"]: (r["mean"], r["std"]) for r in checks if r["column"] not in empty}
        near, doubtful = pairwise_r(gram_matrix(df, scales), list(scales), rest)
        found.update(near)
        for start in range(0, len(doubtful), PAIRS_PER_AGGREGATE):
            chunk = doubtful[start : start + PAIRS_PER_AGGREGATE]
            row = df.agg(*[shape.pearson(col(a), col(b)) for a, b in chunk]).first()
            found.update(zip(chunk, row))
    rows = [(a, b, r, order[(a, b)]) for (a, b), r in found.items() if r is not None and r == r]
    return local_rows(spark, rows, schema).orderBy("position")


def correlation_report(df: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs with r rounded to four digits and its strength (taken from the unrounded r)."""
    pairs = correlation_pairs(df) if pairs is None else pairs
    return pairs.select(
        "col1",
        "col2",
        F.round("r", 4).alias("correlation"),
        grades.correlation_strength(F.col("r")).alias("strength"),
        "position",
    ).orderBy("position")


def correlation_matrix(df: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The full matrix in long form, diagonal included: ``col1, col2, r``."""
    pairs = correlation_pairs(df) if pairs is None else pairs
    ones = per_column(
        nan_to_null(df), numeric_columns(df), lambda c: {"std": F.stddev_samp(col(c))}, "std double"
    ).filter("std > 0")
    diagonal = ones.select(F.col("column").alias("col1"), F.col("column").alias("col2"), F.lit(1.0).alias("r"))
    upper = pairs.select("col1", "col2", "r")
    lower = pairs.select(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "r")
    return upper.unionByName(lower).unionByName(diagonal)


def correlation_top(df: DataFrame, top: int = TOP_PAIRS, pairs: DataFrame | None = None) -> DataFrame:
    """The most positive and the most negative pairs: ``direction, col1, col2, correlation, strength``."""
    report = correlation_report(df, pairs)
    positive = report.filter("correlation > 0").orderBy(F.desc("correlation"), "position").limit(top)
    negative = report.filter("correlation < 0").orderBy("correlation", F.desc("position")).limit(top)
    return (
        positive.withColumn("direction", F.lit("positive"))
        .unionByName(negative.withColumn("direction", F.lit("negative")))
        .select("direction", "col1", "col2", "correlation", "strength", "position")
    )


def correlation_summary(df: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row: ``strong_count, summary``. The sentence names the most positive pair."""
    if len(numeric_columns(df)) < 2:
        rows = [(0, "Insufficient numeric columns for correlation analysis.")]
        return local_rows(df.sparkSession, rows, "strong_count bigint, summary string")
    report = correlation_report(df, pairs)
    order = F.struct(-F.col("correlation"), F.col("position"))
    text = F.concat("col1", F.lit(" & "), "col2", F.lit(" (r="), F.col("correlation").cast("string"), F.lit(")."))
    totals = report.agg(
        F.count_if(F.abs("correlation") > STRONG).alias("strong_count"), F.min_by(text, order).alias("top")
    )
    count = F.col("strong_count").cast("string")
    return totals.select(
        "strong_count",
        F.when(
            F.col("strong_count") == 0, F.lit("No strong correlations (|r| > 0.7) found between numeric features.")
        )
        .when(F.col("strong_count") <= 3, F.concat(count, F.lit(" strong correlation(s) found. Strongest: "), "top"))
        .otherwise(
            F.concat(
                count,
                F.lit(
                    " strong correlations found — possible multicollinearity. Consider feature selection or PCA."
                ),
            )
        )
        .alias("summary"),
    )


def correlation_top15(df: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Both top lists together by absolute r, fifteen rows."""
    return (
        correlation_top(df, TOP_PAIRS, pairs)
        .orderBy(F.desc(F.abs("correlation")), "position")
        .limit(DISPLAY_PAIRS)
        .select("col1", "col2", "correlation", "strength")
    )


def strongest_pair(df: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The pair with the largest absolute r: ``col1, col2, r``."""
    pairs = correlation_pairs(df) if pairs is None else pairs
    return pairs.orderBy(F.desc(F.abs("r")), "position").limit(1).select("col1", "col2", "r")


def local_pairs(df: DataFrame) -> DataFrame:
    """The pairs as local rows, for several correlation reports over one pass."""
    return collected(correlation_pairs(df))
