"""Expressions over counts and population moments: corrected moments and the omnibus test of normality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corrected_skewness(n: Column, g1: Column) -> Column:
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1.0)) / (n - 2))


def corrected_kurtosis(n: Column, g2: Column) -> Column:
    return F.when(n >= 4, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * g2 + 6))


def omnibus(n: Column, g1: Column, g2: Column) -> Column:
    """The D'Agostino-Pearson statistic from the number of values and their population skewness and excess kurtosis."""
    n = n.cast("double")
    y0 = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    y = F.when(y0 == 0, 1.0).otherwise(y0)
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.ln(w2))
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - e) / F.sqrt(v)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    z2 = ((1 - 2 / (9 * a)) - F.signum(d) * F.cbrt((1 - 2 / a) / F.abs(d))) / F.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


def distribution(n: Column, g1: Column, g2: Column) -> Column:
    """A label for the shape of a numeric column; the order of the rules matters."""
    skew, kurt = corrected_skewness(n, g1), corrected_kurtosis(n, g2)
    return (
        F.when(n < 8, "insufficient_data")
        .when(omnibus(n, g1, g2) < -2 * F.ln(F.lit(0.05)), "gaussian")
        .when((F.abs(skew) < 0.5) & (kurt < -1), "uniform")
        .when(F.abs(skew) > 2, "zipf_like")
        .when((kurt < -0.5) & (F.abs(skew) < 1), "bimodal")
        .when(skew > 1, "skewed_right")
        .when(skew < -1, "skewed_left")
        .otherwise("non_gaussian")
    )
