"""Order base: shipped retail lines with item, vendor, company and amounts."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scope import Scope
from ..sources.tables import Sources

PROFILE = (
    "item_name", "category_code", "category_name", "brand_code", "brand_name",
    "vendor_code", "company_code", "company_name",
)


def category_name(code: Column, categories: dict) -> Column:
    label = F
    for number, name in categories.items():
        label = label.when(code == number, name)
    return label


def in_place(df: DataFrame, scope: Scope) -> DataFrame:
    """Rows of the scope's marketplace and region, as far as it names them."""
    if scope.marketplace_id is not None:
        df = df.filter(F.col("marketplace_id") == scope.marketplace_id)
    if scope.region_id is not None:
        df = df.filter(F.col("region_id") == scope.region_id)
    return df


def shipped_lines(
    src: Sources,
    scope: Scope,
    run_date: date,
    whole_run_day: bool = False,
    drop_conditions: bool = True,
    dedupe: bool = True,
) -> DataFrame:
    """Shipped retail order lines of the history.

    The history ends at midnight of the run date; `whole_run_day` keeps the orders of
    that day (v2). Both bounds are plain comparisons, so they reach the file scan. What the
    scope leaves open of marketplace and region is a column of the lines.
    """
    ts = F.col("order_ts")
    last = ts < F.lit(run_date + timedelta(days=1)) if whole_run_day else ts <= F.lit(run_date)
    lines = in_place(src.shipments, scope).filter(
        (F.col("units") > 0)
        & (F.col("is_retail") == "Y")
        & (ts >= F.lit(scope.first_day(run_date)))
        & last
    )
    if drop_conditions:
        lines = lines.filter(~F.col("condition_code").isin(*scope.excluded_conditions))
    lines = lines.select(
        "item_id", "customer_id", "line_id", F.to_date("order_ts").alias("order_date"), "units",
        *scope.open_places,
    )
    return lines.dropDuplicates() if dedupe else lines


def item_profile(
    src: Sources,
    scope: Scope,
    company: str | None = None,
    vendor: bool = True,
    dedupe: bool = True,
) -> DataFrame:
    """One wide dimension: item, category, brand and (optional) vendor and company.

    The dimensions are joined to each other first, so the order lines meet them in
    a single join. Places that the scope leaves open are columns of it, as of the lines.
    Items and their vendors are never broadcast: Spark would go by the compressed size of their
    files, and a task would hold many times that, growing with the items.
    """
    places = scope.open_places
    profile = in_place(src.items, scope).filter(
        F.col("category_code").isin(*scope.categories)
    ).select(
        "item_id", "item_name", "category_code",
        category_name(F.col("category_code"), scope.categories).alias("category_name"),
        "brand_code", "brand_name", *places,
    )
    if vendor:
        vendors = in_place(src.item_vendor, scope).select("item_id", "vendor_code", *places)
        companies = src.vendor_company.select("vendor_code", "company_code", "company_name")
        profile = profile.join(
            vendors.join(companies, "vendor_code", "left").hint("merge"), ["item_id", *places], "left"
        )
    if company is not None:
        profile = profile.filter(F.col("company_code") == company)
    return profile.dropDuplicates() if dedupe else profile


def attach_amounts(
    orders: DataFrame,
    contribution: DataFrame,
    marketplace_id: int | None,
    amounts=("revenue",),
    dedupe: bool = True,
) -> DataFrame:
    """Add the amounts of each line, 0 where there are none.

    `marketplace_id=None` takes the amounts of any marketplace (v1), unless the orders have a
    marketplace: then each finds the amounts of its own, and the column goes.
    """
    keys = ["line_id", "item_id", *(c for c in orders.columns if c == "marketplace_id")]
    if marketplace_id is not None:
        contribution = contribution.filter(F.col("marketplace_id") == marketplace_id)
    values = [F.coalesce(F.col(a), F.lit(0)).alias(a) for a in amounts]
    lines = contribution.select(*keys, *values).dropna(subset=keys)
    if dedupe:
        # dealt by the keys of the join, so that the distinct rows are not shuffled again
        lines = lines.repartition(*keys).dropDuplicates()
    joined = orders.join(lines, keys, "left").withColumns(
        {a: F.coalesce(F.col(a), F.lit(0)) for a in amounts})
    if len(keys) == 2:
        return joined
    joined = joined.drop("marketplace_id")
    return joined.dropDuplicates() if dedupe else joined


def base_lines(src: Sources, scope: Scope, run_date: date, **options) -> DataFrame:
    """Base orders without amounts: what period matching and first purchases need.

    An open marketplace stays a column, by which `attach_amounts` finds a line's amounts.
    """
    company = options.pop("company", None)
    lines = shipped_lines(src, scope, run_date, **options)
    places = scope.open_places
    profile = item_profile(src, scope, company).hint("merge")
    joined = lines.join(profile, ["item_id", *places]).select(
        "item_id", "customer_id", "line_id", "order_date", "units", *PROFILE,
        *(c for c in places if c == "marketplace_id"),
    )
    # without the region, lines of two regions can be the same row
    return joined.dropDuplicates() if "region_id" in places else joined


def base_orders(src: Sources, scope: Scope, run_date: date) -> DataFrame:
    """Base orders v3, each distinct row once.

    Duplicates are dropped on the narrow inputs before the joins. Every input column
    is an output column, so distinct inputs can only give distinct rows and the wide
    result needs no second pass.
    """
    base = base_lines(src, scope, run_date)
    return attach_amounts(base, src.contribution, scope.marketplace_id)


def base_lines_v1(src: Sources, scope: Scope, run_date: date) -> DataFrame:
    """Base orders v1 without amounts: every condition, duplicates kept, no vendor."""
    lines = shipped_lines(src, scope, run_date, drop_conditions=False, dedupe=False)
    profile = item_profile(src, scope, vendor=False, dedupe=False).hint("merge")
    return lines.join(profile, ["item_id", *scope.open_places]).select(
        "item_id", "customer_id", "line_id", "order_date", "units",
        "item_name", "category_code", "brand_code", "brand_name",
    )


def attach_amounts_v1(lines: DataFrame, contribution: DataFrame) -> DataFrame:
    """Revenue, ads and subscription amounts of any marketplace."""
    amounts = ("revenue", "ads_amt", "subscription_amt")
    return attach_amounts(lines, contribution, None, amounts, dedupe=False)


def base_orders_amounts(src: Sources, scope: Scope, run_date: date) -> DataFrame:
    """Base orders v1 with three amounts."""
    return attach_amounts_v1(base_lines_v1(src, scope, run_date), src.contribution)


def base_orders_company(
    src: Sources, scope: Scope, run_date: date, company: str | None
) -> DataFrame:
    """Base orders v2: one company (None: all), by calendar date, the run date included."""
    base = base_lines(src, scope, run_date, company=company, whole_run_day=True)
    return attach_amounts(base, src.contribution, scope.marketplace_id)


def daily_subscribers(
    subscriptions: DataFrame, scope: Scope, run_date: date, any_region: bool = False
) -> DataFrame:
    """Mean number of active subscribers by item and day (`any_region`: v2)."""
    rows = in_place(subscriptions, replace(scope, region_id=None) if any_region else scope).filter(
        F.col("category_code").isin(*scope.categories)
        & (F.col("snapshot_date") >= F.lit(scope.first_day(run_date)))
    )
    return rows.groupBy("item_id", F.to_date("snapshot_date").alias("metric_date")).agg(
        F.avg("active_subscribers").alias("daily_subscribers")
    )
