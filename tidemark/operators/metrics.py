"""Daily deal and benchmark metrics at five levels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.growth import daily
from ..scope import BENCHMARK_DAYS
from .events import duration_days
from .firsts import FLAGS
from .periods import DEAL, PRE_DEAL

METRICS = ("shipped_units", "ops", "customers", "new_customers", "subscribers")
EVENT = ("event_name", "event_year", "event_month")


@dataclass(frozen=True)
class Level:
    """One reporting level.

    `keys` match deal to benchmark and to last year, `columns` are the deal groups,
    `flags` make a customer new (any of them), `zero_last_year` fills a missing year.
    """

    name: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    flags: tuple[str, ...]
    required: str | None = None
    zero_last_year: bool = True


LEVELS = {
    level.name: level
    for level in (
        Level(
            "item", ("item_id",),
            (
                "item_id", "item_name", "category_code", "category_name", "brand_code",
                "brand_name", "vendor_code", "company_code", "company_name",
            ),
            ("is_first_item_purchase",), zero_last_year=False,
        ),
        Level(
            "brand", ("brand_code",),
            (
                "brand_code", "brand_name", "vendor_code", "company_code", "company_name",
                "category_code", "category_name",
            ),
            ("is_first_brand_purchase",), required="brand_code",
        ),
        Level(
            "company", ("company_code", "category_code"),
            ("company_code", "company_name", "category_code", "category_name"),
            ("is_first_company_purchase",), required="company_code",
        ),
        Level(
            "category", ("category_code",), ("category_code", "category_name"),
            ("is_first_category_purchase",), required="category_code",
        ),
        Level("event", (), (), tuple(FLAGS), zero_last_year=False),
    )
}


def _per_customer(flags: DataFrame, group, period: str, new_flags) -> DataFrame:
    """One row per group and customer, so that distinct customers become plain counts.

    Several COUNT(DISTINCT CASE ...) would multiply every row once per count; this
    combines on the map side and spreads even a single huge group over its customers.
    """
    inside = F.col("period_type") == period
    new = reduce(lambda a, b: F.greatest(a, b), (F.col(f) for f in new_flags))
    return flags.groupBy(*group, "customer_id").agg(
        F.min("promo_start_date").alias("promo_start_date"),
        F.max("promo_end_date").alias("promo_end_date"),
        F.max("event_duration_days").alias("event_duration_days"),
        F.sum(F.when(inside, F.col("units"))).alias("units"),
        F.sum(F.when(inside, F.col("revenue"))).alias("revenue"),
        F.sum(F.when(inside, F.col("daily_subscribers"))).alias("subscribers"),
        F.count(F.when(inside, 1)).alias("lines"),
        F.sum(F.when(inside, new).otherwise(0)).alias("new_lines"),
    )


def _totals(per_line: bool) -> dict[str, Column]:
    """Sums over customers. `per_line`: new customers counts lines, not customers."""
    known = F.col("customer_id").isNotNull()
    new_customers = F.count(F.when(known & (F.col("new_lines") > 0), 1))
    return {
        "shipped_units": F.sum("units"),
        "ops": F.sum("revenue"),
        "customers": F.count(F.when(known & (F.col("lines") > 0), 1)),
        "new_customers": F.sum("new_lines") if per_line else new_customers,
    }


def _daily_metrics(totals, prefix: str, days, integer: bool) -> list[Column]:
    columns = [
        daily(total, days, integer and name != "ops").alias(f"{prefix}_{name}")
        for name, total in totals.items()
    ]
    subscribers = F.try_divide(F.sum("subscribers"), F.sum("lines"))
    return [*columns, subscribers.alias(f"{prefix}_subscribers")]


def daily_columns(names, prefix: str, days: Column, integer: bool) -> list[Column]:
    """Totals as daily averages; subscribers are a mean already."""
    return [
        (F.col(n) if n == "subscribers" else daily(F.col(n), days, integer and n != "ops"))
        .alias(f"{prefix}_{n}") for n in names
    ]


def deal_metrics(
    flags: DataFrame, level: Level, integer_daily: bool = False, whole_year: bool = False,
    members: DataFrame | None = None,
) -> DataFrame:
    """Daily averages in the deal days.

    A group that only has benchmark orders is kept, with NULL sums and 0 customers.
    `whole_year` gives one row per level keys, event and year, whatever its months and
    other columns: what the year after is compared with. The event level also counts `members`
    (by default those of the flags).
    """
    if level.required:
        flags = flags.filter(F.col(level.required).isNotNull())
    event = ["event_name", "event_year"] if whole_year else list(EVENT)
    group = [*(level.keys if whole_year else level.columns), *event]
    per_customer = _per_customer(flags, group, DEAL, level.flags)
    start, end = F.min("promo_start_date"), F.max("promo_end_date")
    item_level = level.name == "item"
    days = F.max("event_duration_days") if item_level else duration_days(start, end)
    result = per_customer.groupBy(*group).agg(
        start.alias("promo_start_date"),
        end.alias("promo_end_date"),
        days.alias("event_duration_days"),
        *_daily_metrics(_totals(per_line=item_level), "daily_deal", days, integer_daily),
    )
    if item_level:
        known = F.col("item_id").isNotNull().cast("long")
        return result.withColumn("deal_unique_item_count", known)
    if level.name == "event":
        return with_participation(result, event_members(flags) if members is None else members,
                                  event)
    return result


MEMBERS = {
    "item_id": "unique_item_count",
    "brand_code": "unique_brand_count",
    "company_code": "unique_company_count",
}


def event_members(flags: DataFrame) -> DataFrame:
    """Each item, brand and company of an event and month once, and in which periods it is.

    The flags are grouped once, to the items; the three kinds are then rows of their own, so
    that each distinct count is a plain count.
    """
    deal = F.max(F.col("period_type") == DEAL)
    pre = F.max(F.col("period_type") == PRE_DEAL)
    items = flags.groupBy(*EVENT, *MEMBERS).agg(deal.alias("in_deal"), pre.alias("in_pre_deal"))
    kinds = F.array(*[
        F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("member")) for c in MEMBERS
    ])
    return (
        items.select(*EVENT, "in_deal", "in_pre_deal", F.inline(kinds))
        .filter(F.col("member").isNotNull())
        .groupBy(*EVENT, "kind", "member")
        .agg(F.max("in_deal").alias("in_deal"), F.max("in_pre_deal").alias("in_pre_deal"))
    )


def _distinct_members(members: DataFrame, group, period: str, names: dict) -> DataFrame:
    """Distinct members of each kind by event, for the columns of `names`."""
    members = members.groupBy(*group, "kind", "member").agg(
        F.max("in_deal").alias("in_deal"), F.max("in_pre_deal").alias("in_pre_deal")
    )
    inside = F.col("in_deal") if period == DEAL else F.col("in_pre_deal")
    return members.groupBy(*group).agg(*[
        F.count(F.when(inside & (F.col("kind") == kind), 1)).alias(name)
        for kind, name in names.items()
    ])


def with_participation(result: DataFrame, members: DataFrame, event) -> DataFrame:
    """Distinct items, brands and companies in the deal of each event.

    Joined on the event: a few hundred rows on both sides.
    """
    counts = _distinct_members(members, event, DEAL, MEMBERS)
    return result.join(counts, list(event), "left").withColumns(
        {n: F.coalesce(n, F.lit(0)) for n in MEMBERS.values()}
    )


def pre_deal_metrics(
    flags: DataFrame,
    level: Level,
    benchmark_days: int = BENCHMARK_DAYS,
    integer_daily: bool = False,
    members: DataFrame | None = None,
) -> DataFrame:
    """Daily averages in the benchmark days, by level keys, event and year.

    The event level keeps events without a benchmark (NULL sums).
    """
    group = [*level.keys, "event_name", "event_year"]
    is_event = level.name == "event"
    rows = flags if is_event else flags.filter(F.col("period_type") == PRE_DEAL)
    per_customer = _per_customer(rows, group, PRE_DEAL, level.flags)
    totals = _totals(per_line=level.name == "item")
    result = per_customer.groupBy(*group).agg(
        *_daily_metrics(totals, "daily_pre_deal", benchmark_days, integer_daily)
    )
    if not is_event:
        return result
    return with_benchmark_items(result, event_members(flags) if members is None else members, group)


def with_benchmark_items(result: DataFrame, members: DataFrame, event) -> DataFrame:
    """Distinct items in the benchmark of each event."""
    names = {"item_id": "pre_deal_unique_item_count"}
    items = _distinct_members(members, event, PRE_DEAL, names)
    return result.join(items, list(event), "left").fillna(0, list(names.values()))


def deal_keys(flags: DataFrame, level: Level) -> DataFrame:
    """The distinct keys of a level that have a deal, by event and year."""
    return (
        flags.filter(F.col("period_type") == DEAL)
        .select(*level.keys, "event_name", "event_year")
        .distinct()
    )
