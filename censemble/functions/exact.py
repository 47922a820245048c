"""Sums of doubles that do not depend on the order of rows.

Adding doubles rounds after every step, so another partitioning gives other last digits. Here a value
is split into two whole numbers, in units of 2**-26 and 2**-52; their sums are exact, and one rounding
at the end is the same for any order. What lies below 2**-52 of a value is left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = float(1 << 26)


def halves(value: Column) -> tuple[Column, Column]:
    """A value in units of 2**-26, and what is left of it in units of 2**-52, as whole numbers."""
    high = F.floor(value * UNIT)
    return high, F.floor((value * UNIT - high) * UNIT)


def whole(high: Column, low: Column) -> Column:
    """The double next to sums of ``halves``."""
    return (high.cast("double") + low.cast("double") / UNIT) / UNIT


def exact_sum(value: Column) -> Column:
    """The sum of the values that are not null, null if there are none; for totals below 2**36.

    NaN or an infinite value among them gives NaN.
    """
    odd = F.isnan(value - value)
    high, low = halves(F.when(~odd, value))
    return F.when(F.count(F.when(odd, 1)) > 0, F.lit(float("nan"))).otherwise(whole(F.sum(high), F.sum(low)))


def exact_mean(value: Column) -> Column:
    """The mean of the values that are not null, null if there are none."""
    return exact_sum(value) / F.nullif(F.count(value), F.lit(0))
