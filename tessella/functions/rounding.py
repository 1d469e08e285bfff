"""Rounding in whole units, so that exact ties round up on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def units(value: Column, scale: int = 10_000) -> Column:
    return F.round(value * scale).cast("long")


def rounded(value: Column, scale: int = 10_000) -> Column:
    """value rounded to a fraction of scale; a tie that was computed a little too low rounds up too."""
    return F.round(value * scale) / scale


def half_up(whole: Column, by: int | Column, scale: int = 10_000) -> Column:
    """whole / by, rounded to a whole number with ties up, as a fraction of scale."""
    return F.floor((2 * whole + by) / (2 * by)) / scale


def mean_of(value: Column) -> Column:
    """Aggregate: the mean to four places of values of up to six."""
    return half_up(F.sum(units(value, 1_000_000)), 100 * F.count(value))
