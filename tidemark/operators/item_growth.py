"""v1: item and brand metrics per promotion window, growth ratios."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.growth import daily, growth_ratio
from ..scope import BENCHMARK_DAYS_V1, Scope
from .compare import with_last_year
from .events import duration_days
from .orders import category_name, in_place

AMOUNTS = {
    "shipped_units": "units",
    "ops": "revenue",
    "ads_amt": "ads_amt",
    "subscription_amt": "subscription_amt",
}
MONEY = ("ops", "ads_amt", "subscription_amt")
CUSTOMER_GROUPS = ("total_customers", "new_customers", "return_customers")
FLAG = "is_first_brand_purchase"


def _totals(summary: DataFrame, group) -> DataFrame:
    """Amounts and distinct total, new and returning customers per group.

    A customer with first and later orders in the group is both new and returning.
    Grouped by customer first, so that distinct counts become plain counts.
    """
    per_customer = summary.groupBy(*group, "customer_id").agg(
        *[F.sum(c).alias(name) for name, c in AMOUNTS.items()],
        F.max(FLAG).alias("any_first"),
        F.min(FLAG).alias("all_first"),
    )
    known = F.col("customer_id").isNotNull()
    return per_customer.groupBy(*group).agg(
        *[F.sum(name).alias(name) for name in AMOUNTS],
        F.count(F.when(known, 1)).alias("total_customers"),
        F.count(F.when(known & (F.col("any_first") == 1), 1)).alias("new_customers"),
        F.count(F.when(known & (F.col("all_first") == 0), 1)).alias("return_customers"),
    )


def _daily(
    names, prefix: str, days: Column | int, suffix: str = "", integer: bool = False
) -> list[Column]:
    """`integer` truncates units and customers, which are whole numbers; amounts are not."""
    return [
        daily(F.col(n), days, integer and n not in MONEY).alias(f"{prefix}_{n}{suffix}")
        for n in names
    ]


def brand_customers(summary: DataFrame) -> DataFrame:
    """Distinct customers by brand, event and start date."""
    group = ("brand_code", "event_name", "promo_start_date")
    return _totals(summary, group).select(
        *group, *[F.col(c).alias(f"{c}_brand") for c in CUSTOMER_GROUPS]
    )


def deal_metrics_v1(
    summary: DataFrame, item_vendor: DataFrame, scope: Scope, run_date: date,
    integer_daily: bool = False,
) -> DataFrame:
    """Daily deal metrics by item and promotion window, with its brand's customers.

    An item with several vendors gives one row for each of them.
    """
    group = (
        "item_id", "item_name", "category_code", "brand_code", "brand_name", "event_name",
        "promo_start_date", "promo_end_date",
    )
    start = F.col("promo_start_date")
    items = _totals(summary, group).withColumns({
        "event_month": F.month(start),
        "event_year": F.year(start),
        "event_duration_days": duration_days(start, F.col("promo_end_date"), run_date),
    })
    vendors = in_place(item_vendor, scope).select("item_id", "vendor_code")
    if scope.open_places:
        vendors = vendors.distinct()  # the same vendor in several places
    days = F.col("event_duration_days")
    return (
        items.join(
            brand_customers(summary), ["brand_code", "event_name", "promo_start_date"], "left"
        )
        .join(vendors, "item_id", "left")
        .select(
            *group, "event_month", "event_year", "event_duration_days", "vendor_code",
            *_daily(AMOUNTS, "daily_deal", days, integer=integer_daily),
            *_daily(CUSTOMER_GROUPS, "daily_deal", days, "_item", integer_daily),
            *_daily([f"{c}_brand" for c in CUSTOMER_GROUPS], "daily_deal", days, "",
                    integer_daily),
        )
    )


def pre_deal_metrics_v1(
    summary: DataFrame, days: int = BENCHMARK_DAYS_V1, integer_daily: bool = False
) -> DataFrame:
    """Daily benchmark metrics by item, event and start, with its brand's customers."""
    group = ("item_id", "item_name", "brand_code", "event_name", "promo_start_date")
    items = _totals(summary, group)
    return items.join(
        brand_customers(summary), ["brand_code", "event_name", "promo_start_date"], "left"
    ).select(
        *group,
        *_daily(AMOUNTS, "daily_pre_deal", days, integer=integer_daily),
        *_daily(CUSTOMER_GROUPS, "daily_pre_deal", days, "_item", integer_daily),
        *_daily([f"{c}_brand" for c in CUSTOMER_GROUPS], "daily_pre_deal", days, "",
                integer_daily),
    )


def window_days(windows: DataFrame, days: int) -> DataFrame:
    """Three rows a window: the days whose running sums give its deal and its benchmark.

    The sum over some days is the sum up to the last less the sum up to the day before the first,
    so `deal` and `pre` are the window's weight with the sign of that day. A period without
    days has no weight, but its window keeps its rows.
    """
    start, end, weight = F.col("promo_start_date"), F.col("promo_end_date"), F.col("weight")
    before = F.date_sub(start, 1)
    none = F.lit(0).cast("long")
    deal = F.when(start <= end, weight).otherwise(none)
    pre = F.when(F.date_sub(start, days) <= before, weight).otherwise(none)
    points = [(F.date_sub(start, days + 1), none, -pre), (before, -deal, pre), (end, deal, none)]
    return windows.select("item_id", "event_name", "promo_start_date", F.inline(F.array(*[
        F.struct(day.alias("day"), d.alias("deal"), p.alias("pre")) for day, d, p in points
    ])))


def sums_up_to(points: DataFrame, by_day: DataFrame) -> DataFrame:
    """`points` with the sums of the item's totals and counts up to their day.

    `by_day` has a total and a count for each item and day. Both kinds of rows run through one
    window over the item's days, so that nothing is repeated or gathered for days without a
    row. Points of items without any day go.
    """
    item = Window.partitionBy("item_id").orderBy("day")
    rows = points.withColumn("is_point", F.lit(True)).unionByName(
        by_day.filter(F.col("day").isNotNull()).withColumn("is_point", F.lit(False)),
        allowMissingColumns=True,
    )
    whole = item.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = item.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        *points.columns, "is_point",
        *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_upto") for c in ("total", "n")],
        F.min("is_point").over(whole).alias("without_days"),
    ).filter(F.col("is_point") & ~F.col("without_days")).drop("is_point", "without_days")


def subscriber_metrics_v1(
    subscriptions: DataFrame, promos: DataFrame, scope: Scope, days: int = BENCHMARK_DAYS_V1
) -> DataFrame:
    """Mean subscribers in the deal and in the days before it.

    The mean runs over snapshots x promotion lines of the item. Both sides are reduced
    before they meet: lines to windows with a weight, snapshots to one row per item and day.
    A window then takes the running sums of three days, whatever its length. The snapshots are
    read once, and items without any snapshot find no row.
    """
    by_day = (
        in_place(subscriptions, replace(scope, region_id=None))
        .filter(F.col("category_code").isin(*scope.categories))
        .groupBy("item_id", F.to_date("snapshot_date").alias("day"))
        .agg(F.sum("active_subscribers").alias("total"), F.count("active_subscribers").alias("n"))
    )
    windows = promos.groupBy("item_id", "event_name", "promo_start_date", "promo_end_date").agg(
        F.count("*").alias("weight")
    )

    def mean(weight: str) -> Column:
        total, n = (F.sum(F.col(weight) * F.col(f"{c}_upto")) for c in ("total", "n"))
        return F.try_divide(total, n)

    return (
        sums_up_to(window_days(windows, days), by_day)
        .groupBy("item_id", "promo_start_date", "event_name")
        .agg(
            mean("deal").alias("avg_deal_subscribers"),
            mean("pre").alias("avg_pre_deal_subscribers"),
        )
    )


GROWTH_KEYS = (
    "item_id", "item_name", "category_name", "vendor_code", "company_name", "company_code",
    "brand_code", "brand_name", "event_name", "promo_start_date", "promo_end_date",
    "event_month", "event_year", "event_duration_days",
)
V1_METRICS = (
    *AMOUNTS,
    *(f"{c}_item" for c in CUSTOMER_GROUPS),
    *(f"{c}_brand" for c in CUSTOMER_GROUPS),
    "subscribers",
)
V1_DEAL = tuple(f"daily_deal_{m}" for m in V1_METRICS)
V1_PRE_DEAL = tuple(f"daily_pre_deal_{m}" for m in V1_METRICS)
GROWTH = {
    "daily_new_customer_growth_pct_item": "new_customers_item",
    "daily_return_customer_growth_pct_item": "return_customers_item",
    "daily_new_customer_growth_pct_brand": "new_customers_brand",
    "daily_return_customer_growth_pct_brand": "return_customers_brand",
    "daily_subscribers_growth_pct": "subscribers",
}


def deal_growth_v1(
    deal: DataFrame, pre: DataFrame, subscribers: DataFrame, vendor_company: DataFrame,
    scope: Scope,
) -> DataFrame:
    """Deal rows with benchmark, subscribers, company and growth ratios.

    Matched on the start date: an item whose lines start on different days of one
    month finds its benchmark only at the first of them.
    """
    match = ["item_id", "event_name", "promo_start_date"]
    pre = pre.drop("item_name", "brand_code")
    s = subscribers.select(
        *match,
        F.col("avg_deal_subscribers").alias("daily_deal_subscribers"),
        F.col("avg_pre_deal_subscribers").alias("daily_pre_deal_subscribers"),
    )
    companies = vendor_company.select("vendor_code", "company_code", "company_name")
    joined = (
        deal.filter(F.col("promo_start_date").isNotNull())
        .join(pre, match, "left")
        .join(s, match, "left")
        .join(companies, "vendor_code", "left")
        .withColumn("category_name", category_name(F.col("category_code"), scope.categories))
    )
    growth = {
        name: growth_ratio(F.col(f"daily_deal_{m}"), F.col(f"daily_pre_deal_{m}"))
        for name, m in GROWTH.items()
    }
    return joined.withColumns(growth).select(*GROWTH_KEYS, *V1_DEAL, *V1_PRE_DEAL, *growth)


def _years_v1(growth: DataFrame) -> DataFrame:
    """One row per item, event and year: the mean of its windows.

    Deal metrics weigh by the days of each window, so a year with one window keeps its numbers.
    An item's vendors repeat its windows, which count once.
    """
    days = F.col("event_duration_days")
    keys = ["item_id", "event_name", "event_year"]
    windows = growth.select(
        *keys, "promo_start_date", "promo_end_date", days, *V1_DEAL, *V1_PRE_DEAL
    ).distinct()

    def weighed(c: str) -> Column:
        known = F.when(F.col(c).isNotNull(), days)
        return F.try_divide(F.sum(F.col(c) * days), F.sum(known)).alias(c)

    return windows.groupBy(*keys).agg(
        *[weighed(c) for c in V1_DEAL], *[F.avg(c).alias(c) for c in V1_PRE_DEAL]
    )


def report_item_v1(growth: DataFrame) -> DataFrame:
    """Growth rows with last year's deal and benchmark metrics: as many rows as `growth`."""
    return with_last_year(growth, _years_v1(growth), ("item_id",), (*V1_DEAL, *V1_PRE_DEAL))


def sorted_growth_v1(growth: DataFrame) -> DataFrame:
    """For display: latest start first, then the largest total sales."""
    return growth.orderBy(
        F.col("promo_start_date").desc_nulls_first(),
        (F.col("daily_deal_ops") * F.col("event_duration_days")).desc_nulls_first(),
    )
