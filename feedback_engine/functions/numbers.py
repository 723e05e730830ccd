"""Guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_if(condition: Column) -> Column:
    """Rows that meet a condition, as a long that is never null."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def half_up(value: Column, digits: int = 1) -> Column:
    """A double rounded by its multiple, as the SQL does: 29.849999999999998 (44775 of 150000) gives 29.9; F.round goes by the digits printed and gives 29.8."""
    return F.round(value * 10.0**digits, 0) / 10.0**digits


def percent(part: Column, whole: Column, digits: int = 1, half_even: bool = False) -> Column:
    """part / whole in percent; 0 where whole is 0 or null."""
    value = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.coalesce(F.bround(value, digits) if half_even else half_up(value, digits), F.lit(0.0))


def change_percent(now: Column, before: Column) -> Column:
    """Whole percent of change; null without a base."""
    return F.round(F.try_divide((now - before).cast("double"), before.cast("double")) * 100, 0).cast("long")


#: Hours below the bound belong to the bracket; the last has no bound.
BRACKETS = (
    (10, "0-10h (Newcomer)"),
    (50, "10-50h (Casual)"),
    (100, "50-100h (Regular)"),
    (200, "100-200h (Dedicated)"),
    (500, "200-500h (Veteran)"),
    (1000, "500-1000h (Hardcore)"),
    (None, "1000h+ (No-lifer)"),
)


def bracket(hours: Column) -> Column:
    out = F
    for bound, label in BRACKETS[:-1]:
        out = out.when(hours < bound, label)
    return out.otherwise(BRACKETS[-1][1])


def first_positive(first: Column, second: Column) -> Column:
    """first where it is above 0, else second."""
    return F.when(first > 0, first).otherwise(second)
