"""Shares, ratios and growth, computed in double and rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(c: Column) -> Column:
    return c.cast("double")


def percent(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole; null where the whole is null or zero."""
    return F.round(F.try_divide(_double(F.lit(100)) * part, _double(whole)), digits)


def ratio(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.try_divide(_double(part), _double(whole)), digits)


def growth_percent(old: Column, new: Column, digits: int = 1) -> Column:
    """Null unless both counts exist."""
    return percent(new - old, old, digits)
