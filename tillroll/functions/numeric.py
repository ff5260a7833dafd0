"""Rounding, ratios, clipping and exact money sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 2) -> Column:
    """SQL ROUND (ties away from zero), done in decimal so binary noise cannot tip a tie."""
    return F.round(x.cast("decimal(38,10)"), places).cast("double")


def half_even(x: Column, places: int = 0) -> Column:
    """Round with ties to the even neighbour."""
    return F.bround(x, places)


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double; null when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(num: Column, den: Column, places: int = 2) -> Column:
    return half_up(ratio(num, den) * 100, places)


def mean(x: Column, places: int = 2) -> Column:
    """Rounded average taken from an exact sum."""
    return half_up(ratio(F.sum(x), F.count(x)), places)


def money_total(x: Column) -> Column:
    """Sum to the hundredth of a cent, independent of row order; 0 when nothing is there.

    Adding doubles gives a different last digit for every partitioning of the
    same rows; adding decimals does not.
    """
    return F.coalesce(F.sum(x.cast("decimal(18,4)")).cast("double"), F.lit(0.0))


def clip(x: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Limit x to [lower, upper]; nulls stay null, and a missing bound does not limit."""
    out = x
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(x.isNotNull(), out)


def distinct_count(x: str, rsd: float | None = None) -> Column:
    """Exact distinct count, or a bounded sketch when a relative error is given."""
    return F.count_distinct(F.col(x)) if rsd is None else F.approx_count_distinct(x, rsd)
