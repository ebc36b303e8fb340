"""Ratios, percent changes and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that is NULL when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0).cast("bigint"))


def percent_change(current: Column, previous: Column) -> Column:
    """Change in percent; zero when the previous value is zero, NULL when it is NULL."""
    change = F.try_divide(current - previous, previous) * 100
    return F.when(previous == 0, F.lit(0.0)).otherwise(change)


def fixed_point(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded half-even on the exact binary value.

    ``round`` in Spark rounds the shortest decimal form of a double (2.675 gives 2.68);
    number formatting looks at the exact value, as printf-style formatting does.
    """
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value, F.lit(pattern))


def exact_round(value: Column, digits: int) -> Column:
    """Round half-even on the exact binary value, as printf and Python's round do."""
    return fixed_point(value, digits).try_cast("double")
