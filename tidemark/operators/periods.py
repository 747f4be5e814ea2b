"""Orders inside deal and benchmark windows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scope import BENCHMARK_DAYS, BENCHMARK_DAYS_V1
from .events import WINDOW_COLUMNS, benchmark_window, duration_days
from .prefilter import key_filter, keep_marked

DEAL = "DEAL"
PRE_DEAL = "PRE_DEAL"


def _date_bin(day: Column, bin_days: int) -> Column:
    return F.floor(F.unix_date(day) / bin_days)


def same_bin(base: DataFrame, windows: DataFrame, bin_days: int) -> DataFrame:
    """Orders of an item with each of its windows that has days in the order's bin.

    Days are cut into bins of about a window's length. A window has a row for each bin that it
    touches, mostly two, and an order is in one bin, so they meet once at most: an order meets the
    windows of its own weeks, not all of the history, and a hot item is spread over its bins.
    Orders of items without any window are dropped before they are shuffled.
    """
    first, last = (_date_bin(F.col(c), bin_days)
                   for c in ("pre_deal_start_date", "pre_deal_end_date"))
    binned = windows.withColumnRenamed("item_id", "w_item_id").filter(
        F.col("pre_deal_start_date") <= F.col("pre_deal_end_date")
    ).withColumn("w_bin", F.explode(F.sequence(first, last)))
    marked = keep_marked(base, ["item_id"], key_filter(windows, ["item_id"]))
    marked = marked.withColumn("bin", _date_bin(F.col("order_date"), bin_days))
    same = (F.col("item_id") == F.col("w_item_id")) & (F.col("bin") == F.col("w_bin"))
    return marked.join(binned, same).drop("bin", "w_bin", "w_item_id")


def in_windows(base: DataFrame, windows: DataFrame, bin_days: int) -> DataFrame:
    """Orders of an item with each of its windows (`pre_deal_start_date` to `.._end_date`) they lie in."""
    return same_bin(base, windows, bin_days).filter(F.col("order_date").between(
        F.col("pre_deal_start_date"), F.col("pre_deal_end_date")))


def match_pre_deal(
    windows: DataFrame, base: DataFrame, bin_days: int = BENCHMARK_DAYS
) -> DataFrame:
    """Every order of an item in the benchmark days of each of its windows.

    `bin_days`: about the length of a benchmark; it changes the work, not the rows.
    """
    return (
        in_windows(base, windows, bin_days)
        .select(*base.columns, *WINDOW_COLUMNS)
        .withColumn("period_type", F.lit(PRE_DEAL))
    )


def match_deal(deal_lines: DataFrame, base: DataFrame) -> DataFrame:
    """The order lines attached to a promotion and placed in its deal days.

    The lines are sorted and merged: a staged table of them is far larger than its files.
    """
    in_deal = F.col("order_date").between(F.col("deal_start_date"), F.col("deal_end_date"))
    d = deal_lines.select(
        F.col("item_id").alias("d_item_id"), F.col("line_id").alias("d_line_id"), *WINDOW_COLUMNS
    ).hint("merge")
    same_line = (base["item_id"] == d["d_item_id"]) & (base["line_id"] == d["d_line_id"])
    return (
        base.join(d, same_line & in_deal)
        .select(*base.columns, *WINDOW_COLUMNS)
        .withColumn("period_type", F.lit(DEAL))
    )


def with_subscribers(orders: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Add the item's subscribers on the order date, 0 where there are none."""
    s = subscribers.withColumnRenamed("metric_date", "order_date")
    return orders.join(s, ["item_id", "order_date"], "left").withColumn(
        "daily_subscribers", F.coalesce("daily_subscribers", F.lit(0.0))
    )


def pre_deal_orders(windows: DataFrame, base: DataFrame, subscribers: DataFrame) -> DataFrame:
    return with_subscribers(match_pre_deal(windows, base), subscribers)


def deal_orders(deal_lines: DataFrame, base: DataFrame, subscribers: DataFrame) -> DataFrame:
    return with_subscribers(match_deal(deal_lines, base), subscribers)


def match_periods(
    deal_lines: DataFrame, windows: DataFrame, base: DataFrame, bin_days: int = BENCHMARK_DAYS
) -> DataFrame:
    """Benchmark and deal orders in one frame."""
    return match_pre_deal(windows, base, bin_days).unionByName(match_deal(deal_lines, base))


def deal_orders_v1(base: DataFrame, promos: DataFrame, run_date: date) -> DataFrame:
    """v1/v2: lines attached to a promotion, within its days, with its columns."""
    in_deal = F.col("order_date").between(F.col("promo_start_date"), F.col("promo_end_date"))
    duration = duration_days(F.col("promo_start_date"), F.col("promo_end_date"), run_date)
    return (
        base.join(promos, ["item_id", "line_id"])
        .filter(in_deal)
        .withColumns({
            "event_duration_days": duration,
            "period_type": F.lit(DEAL),
            "is_promotion": F.lit("Y"),
        })
    )


def deal_orders_v2(base: DataFrame, promos: DataFrame, run_date: date) -> DataFrame:
    """v2: as v1, with the benchmark window of the deal in every row."""
    return deal_orders_v1(base, promos, run_date).withColumns(
        benchmark_window(F.col("promo_start_date"))
    )


def match_pre_deal_v1(
    base: DataFrame, ranges: DataFrame, bin_days: int = BENCHMARK_DAYS_V1
) -> DataFrame:
    """v1/v2: orders of an item in the benchmark range of each of its events."""
    return (
        in_windows(base, ranges, bin_days)
        .drop("pre_deal_start_date", "pre_deal_end_date")
        .withColumns({"period_type": F.lit(PRE_DEAL), "is_promotion": F.lit("N")})
    )


def pre_deal_orders_v1(
    base: DataFrame, ranges: DataFrame, bin_days: int = BENCHMARK_DAYS_V1
) -> DataFrame:
    return match_pre_deal_v1(base, ranges, bin_days).distinct()
