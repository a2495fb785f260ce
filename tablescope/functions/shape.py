"""Sample skewness, excess kurtosis and the K-squared normality test as column expressions.

Inputs are the population moments that the built-in aggregates return: ``g1`` (skewness) and ``g2`` (excess
kurtosis). ``n`` is cast to double first: its fourth power does not fit in a bigint.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(n: Column, g1: Column, std: Column) -> Column:
    """Adjusted skewness; 0 for a constant column, NULL below three values."""
    n = n.cast("double")
    adjusted = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.when(std == 0, F.lit(0.0)).otherwise(adjusted))


def sample_kurtosis(n: Column, g2: Column, std: Column) -> Column:
    """Adjusted excess kurtosis; 0 for a constant column, NULL below four values."""
    n = n.cast("double")
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.when(std == 0, F.lit(0.0)).otherwise(adjusted))


def skewness_z(n: Column, g1: Column) -> Column:
    """Normal score of the skewness (D'Agostino)."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta = 1 / F.sqrt(0.5 * F.ln(w2))
    alpha = F.sqrt(2 / (w2 - 1))
    return delta * F.ln(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))


def kurtosis_z(n: Column, g2: Column) -> Column:
    """Normal score of the kurtosis (Anscombe and Glynn)."""
    n = n.cast("double")
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - expected) / F.sqrt(variance)
    third = (
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6 + 8 / third * (2 / third + F.sqrt(1 + 4 / (third * third)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    root = F.signum(d) * F.cbrt((1 - 2 / a) / F.abs(d))
    return (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both values are present; NULL when one of them does not vary there."""
    a, b = a.cast("double"), b.cast("double")
    spread = F.stddev_samp(F.when(b.isNotNull(), a)) * F.stddev_samp(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_samp(a, b), spread)


def normality_p(n: Column, g1: Column, g2: Column) -> Column:
    """p-value of the K-squared test: chi-square with two degrees of freedom has the tail exp(-K2/2)."""
    zs, zk = skewness_z(n, g1), kurtosis_z(n, g2)
    return F.exp(-(zs * zs + zk * zk) / 2)
