"""Sample moments as used by data-frame libraries: bias-corrected."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sample_skewness(value: str | Column) -> Column:
    """Adjusted Fisher-Pearson skewness; null below three values, 0 if constant."""
    n, g1 = F.count(value).cast("double"), F.skewness(value)
    adjusted = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return (F.when(n < 3, F.lit(None).cast("double"))
             .when(F.var_pop(value) == 0, F.lit(0.0)).otherwise(adjusted))


def sample_excess_kurtosis(value: str | Column) -> Column:
    """Unbiased excess kurtosis; null below four values, 0 if constant."""
    n, g2 = F.count(value).cast("double"), F.kurtosis(value)
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return (F.when(n < 4, F.lit(None).cast("double"))
             .when(F.var_pop(value) == 0, F.lit(0.0)).otherwise(adjusted))
