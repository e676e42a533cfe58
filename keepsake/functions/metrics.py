"""Aggregate expressions used all over the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_if(condition: Column, value: Column) -> Column:
    """Sum over matching rows; 0 when rows exist but none match."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def whole(number: Column) -> Column:
    return number.cast("decimal(18,0)")


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    """100*part/total in exact decimals, rounded half away from zero; null on a zero total."""
    return F.round(F.try_divide(F.lit(100) * part.cast("decimal(18,2)"), total.cast("decimal(18,2)")), digits)


def percent_of_count(part: Column, total: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(F.lit(100) * whole(part), whole(total)), digits)


def mean(value: str, digits: int = 2) -> Column:
    """Average of a decimal or integer column without double rounding."""
    return F.round(F.try_divide(F.sum(value).cast("decimal(22,2)"), whole(F.count(value))), digits)
