"""Row expressions shared by the operators. All of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score bands, cuts are left-closed.
BANDS = ("Low", "Moderate", "Elevated", "High", "Severe")
BAND_CUTS = (20.0, 40.0, 60.0, 80.0)

SCORE_CENTRE = 50.0
SCORE_SLOPE = 18.0


def col(name: str) -> Column:
    """A column whose name may contain dots."""
    return F.col(f"`{name}`")


def nan_to_null(value: Column) -> Column:
    """NaN sorts above every number in Spark, so it must never reach a band or a rank."""
    return F.when(F.isnan(value), None).otherwise(value)


def finite(value: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def band(score: Column, missing: str | None = None) -> Column:
    out = F.when(score.isNull(), F.lit(missing))
    for cut, name in zip(BAND_CUTS, BANDS):
        out = out.when(score < cut, name)
    return out.otherwise(BANDS[-1])


def band_order(name: Column) -> Column:
    """Position of a band from 0 (Low) to 4 (Severe); -1 for anything unknown."""
    out = F.when(name == BANDS[0], 0)
    for position, known in enumerate(BANDS[1:], start=1):
        out = out.when(name == known, position)
    return out.otherwise(-1)


def half_even(value: Column, digits: int | None) -> Column:
    """Round half to even; ``None`` leaves the value as it is."""
    return value if digits is None else F.bround(value, digits)


def pct_change(value: Column, base: Column) -> Column:
    return F.try_divide(value - base, base) * 100.0


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)
