"""Exact order statistics by three conventions; elements are found by ranges of values, never by sorting a group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.operators.ranges import elements_at

__all__ = ["at_fraction", "clamped", "elements_at", "nearest_rank"]


def clamped(place: Column) -> Column:
    return F.greatest(F.lit(0), F.least(place, F.col("n") - 1))


def nearest_rank(q: float) -> Column:
    """ceil(q n) - 1, clamped."""
    return clamped(F.ceil(F.lit(q) * F.col("n")) - 1)


def at_fraction(q: float) -> Column:
    """int(q n), clamped; at a half this is the upper median."""
    return clamped(F.floor(F.lit(q) * F.col("n")))
