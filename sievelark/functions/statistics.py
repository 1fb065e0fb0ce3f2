"""Aggregate and scalar formulas as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are present; NULL for a constant column."""
    xs = F.when(y.isNotNull(), x.cast("double"))
    ys = F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def normality_p(n: Column, skew: Column, excess: Column) -> Column:
    """p-value of the D'Agostino-Pearson omnibus test; NULL below 8 rows.

    Skewness and kurtosis are each turned into a standard normal value (D'Agostino 1970;
    Anscombe and Glynn 1983). The sum of their squares is chi-square with two degrees of
    freedom, whose tail is exp(-x/2).
    """
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = (
        3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
        / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    )
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z_skew = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(w2) / 2)

    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (excess + 3 - expected) / F.sqrt(variance)
    root_beta = (
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
        * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6 + 8 / root_beta * (2 / root_beta + F.sqrt(1 + 4 / (root_beta * root_beta)))
    denominator = 1 + x * F.sqrt(2 / (a - 4))
    z_kurt = (1 - 2 / (9 * a) - F.cbrt(F.try_divide(1 - 2 / a, denominator))) / F.sqrt(2 / (9 * a))
    return F.when(n >= 8, F.exp(-(z_skew * z_skew + z_kurt * z_kurt) / 2))
