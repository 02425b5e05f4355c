"""Ratios. Every rate in the package is built here, so all divide the same way.

Literals are Python floats: Spark reads ``200000.0`` in SQL text as DECIMAL, which
would truncate the quotient.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE_SCALE = 200_000.0  # cases per 100 full-time workers: 100 x 40 h x 50 weeks
DEATH_SCALE = 100_000_000.0


def scaled(numerator: Column, denominator: Column, scale: float) -> Column:
    """``numerator * scale / denominator`` in double; NULL where the denominator is 0."""
    return F.try_divide(numerator.cast("double") * F.lit(scale), denominator.cast("double"))


def percent(part: Column, whole: Column, places: int | None = None) -> Column:
    value = F.try_divide(F.lit(100.0) * part, whole.cast("double"))
    return value if places is None else F.round(value, places)


def where_positive(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` where the denominator is above zero, else NULL."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def sum_cases(*columns: str) -> Column:
    """Row-wise sum; NULL as soon as one part is NULL."""
    total = F.col(columns[0])
    for name in columns[1:]:
        total = total + F.col(name)
    return total
