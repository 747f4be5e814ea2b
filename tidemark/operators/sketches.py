"""Level metrics with approximate customer counts, all from one table of mergeable sketches.

The exact metrics group the flagged orders by customer for every level and period. Here the orders
are grouped once, by item, event and period, with HyperLogLog sketches of the customers and of the
new customers of each level; every level is then a merge of these rows, which are far fewer than
the orders and need no customer any more. Units, sales, subscribers, dates and numbers of items,
brands and companies stay exact.

A sketch of 2**lg_k slots has a relative standard error of 1.04 / sqrt(2**lg_k): 0.8 % by default.
Up to about 2**lg_k / 11 customers (1,536 by default) it holds them one by one and the count is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scope import BENCHMARK_DAYS
from .events import duration_days
from .firsts import FLAGS
from .metrics import EVENT, LEVELS, METRICS, Level, daily_columns, event_members
from .metrics import with_benchmark_items, with_participation
from .periods import DEAL, PRE_DEAL

LG_K = 14
# Which sketch of new customers a level reads: one for each flag, and one for any of them.
NEW_SKETCH = {level.name: "new_" + "_".join(
    f.removeprefix("is_first_").removesuffix("_purchase") for f in level.flags
) for level in LEVELS.values() if level.name != "item"}


def event_summary(flags: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """One row per item, event, month and period: sums, dates and sketches of customers.

    Unknown customers are in no sketch. `new_lines` counts the lines that are the customer's first
    of the item, as the exact item level does.
    """
    customer = F.col("customer_id")

    def sketch(condition: Column | None = None) -> Column:
        return F.hll_sketch_agg(customer if condition is None else F.when(condition, customer), lg_k)

    new = {}
    for name, column in NEW_SKETCH.items():
        any_of = F.greatest(*map(F.col, LEVELS[name].flags)) if len(
            LEVELS[name].flags) > 1 else F.col(LEVELS[name].flags[0])
        new[column] = sketch(any_of == 1)
    return flags.groupBy(*LEVELS["item"].columns, *EVENT, "period_type").agg(
        F.min("promo_start_date").alias("promo_start_date"),
        F.max("promo_end_date").alias("promo_end_date"),
        F.max("event_duration_days").alias("event_duration_days"),
        F.sum("units").alias("units"),
        F.sum("revenue").alias("revenue"),
        F.sum("daily_subscribers").alias("subscribers"),
        F.count(F.lit(1)).alias("lines"),
        F.sum(next(iter(FLAGS))).alias("new_lines"),
        sketch().alias("customers"),
        *[column.alias(name) for name, column in new.items()],
    )


def _merged(summary: DataFrame, level: Level, group, period: str, *more) -> DataFrame:
    """Sums and estimates of one period in groups of both periods' rows."""
    inside = F.col("period_type") == period

    def total(column: str) -> Column:
        return F.sum(F.when(inside, F.col(column)))

    def estimate(column: str) -> Column:
        # sketches of different sizes may meet, if tables of several runs are merged
        return F.hll_sketch_estimate(F.hll_union_agg(F.when(inside, F.col(column)), True))

    new = (F.coalesce(total("new_lines"), F.lit(0)) if level.name == "item"
           else estimate(NEW_SKETCH[level.name]))
    return summary.groupBy(*group).agg(
        total("units").alias("shipped_units"),
        total("revenue").alias("ops"),
        estimate("customers").alias("customers"),
        new.alias("new_customers"),
        F.try_divide(total("subscribers"), total("lines")).alias("subscribers"),
        *more,
    )


def approximate_deal_metrics(
    summary: DataFrame, level: Level, integer_daily: bool = False, whole_year: bool = False
) -> DataFrame:
    """`metrics.deal_metrics` from an event summary: same columns, customers estimated."""
    if level.required:
        summary = summary.filter(F.col(level.required).isNotNull())
    event = ["event_name", "event_year"] if whole_year else list(EVENT)
    group = [*(level.keys if whole_year else level.columns), *event]
    start, end = F.min("promo_start_date"), F.max("promo_end_date")
    item_level = level.name == "item"
    days = F.max("event_duration_days") if item_level else duration_days(start, end)
    merged = _merged(
        summary, level, group, DEAL, start.alias("promo_start_date"),
        end.alias("promo_end_date"), days.alias("event_duration_days"))
    result = merged.select(
        *group, "promo_start_date", "promo_end_date", "event_duration_days",
        *daily_columns(METRICS, "daily_deal", F.col("event_duration_days"), integer_daily))
    if item_level:
        known = F.col("item_id").isNotNull().cast("long")
        return result.withColumn("deal_unique_item_count", known)
    if level.name == "event":
        return with_participation(result, event_members(summary), event)
    return result


def approximate_pre_deal_metrics(
    summary: DataFrame, level: Level, benchmark_days: int = BENCHMARK_DAYS,
    integer_daily: bool = False,
) -> DataFrame:
    """`metrics.pre_deal_metrics` from an event summary: same columns, customers estimated."""
    group = [*level.keys, "event_name", "event_year"]
    is_event = level.name == "event"
    rows = summary if is_event else summary.filter(F.col("period_type") == PRE_DEAL)
    result = _merged(rows, level, group, PRE_DEAL).select(
        *group, *daily_columns(METRICS, "daily_pre_deal", F.lit(benchmark_days), integer_daily))
    return with_benchmark_items(result, event_members(summary), group) if is_event else result
