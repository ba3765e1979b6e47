"""Exact rounding for ratios of whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_quotient(numerator: Column, denominator: Column) -> Column:
    """Integer division, truncating; null when the denominator is 0."""
    return F.when(denominator != 0, F.call_function("div", numerator, denominator))


def half_up_ratio(numerator: Column, denominator: Column, places: int = 2) -> Column:
    """``numerator / denominator`` rounded half away from zero, as a double.

    Worked in whole numbers, so that a tie is a tie and the order in which partial
    aggregates arrive cannot matter. The denominator is a count, never negative.
    """
    unit = 10 ** places
    size = whole_quotient(F.abs(numerator) * (2 * unit) + denominator, denominator * 2)
    return F.sign(numerator) * size / F.lit(unit)
