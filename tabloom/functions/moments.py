"""Moment statistics with the sample definitions of dataframe libraries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def adjusted_skew(value: Column) -> Column:
    """Adjusted Fisher-Pearson skewness; NULL below three values, 0 for constant columns."""
    n = F.count(value).cast("double")
    correction = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.coalesce(F.skewness(value) * correction, F.lit(0.0)))


def sum_of_squares(value: Column) -> Column:
    """Sum of squared deviations from the mean of the group."""
    return F.coalesce(F.var_pop(value), F.lit(0.0)) * F.count(value)
