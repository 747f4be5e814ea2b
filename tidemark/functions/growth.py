"""Daily averages and growth ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_BASE = 1e-9  # fixed value: what a growth ratio divides by when its base is 0 or missing


def daily(total: Column, days: Column | int, integer: bool = False) -> Column:
    """Average per day. `integer` truncates, as integer division does in the warehouse."""
    days = F.lit(days) if isinstance(days, int) else days
    average = F.try_divide(total.cast("double"), days)
    return average.cast("long") if integer else average


def growth_ratio(deal: Column, base: Column, zero_base: float = ZERO_BASE) -> Column:
    """deal / base - 1, to two places; halves go up, whatever their last binary digit."""
    divisor = F.when(F.coalesce(base, F.lit(0)) == 0, F.lit(zero_base)).otherwise(base)
    ratio = deal.cast("double") / divisor - 1
    return F.round(ratio.cast("decimal(38,9)"), 2).cast("double")
