"""Deal against benchmark, this year against last year, and the report layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import METRICS, Level

DEAL_METRICS = tuple(f"daily_deal_{m}" for m in METRICS)
PRE_DEAL_METRICS = tuple(f"daily_pre_deal_{m}" for m in METRICS)
DELTAS = tuple(f"delta_daily_{m}" for m in METRICS)
PARTICIPATION = {
    "item": ("deal_unique_item_count",),
    "event": ("unique_item_count", "unique_brand_count", "unique_company_count"),
}
LAST_YEAR_NAMES = {"deal_unique_item_count": "ly_unique_item_count"}


def deal_vs_benchmark(deal: DataFrame, pre: DataFrame, level: Level) -> DataFrame:
    """Deal rows with their benchmark and the difference; NULL without a benchmark."""
    joined = deal.join(pre, [*level.keys, "event_name", "event_year"], "left")
    return joined.withColumns({
        f"delta_daily_{m}": F.col(f"daily_deal_{m}") - F.col(f"daily_pre_deal_{m}")
        for m in METRICS
    })


def with_last_year(
    growth: DataFrame, years: DataFrame, keys, columns, zero: bool = False,
    names: dict | None = None,
) -> DataFrame:
    """Add `ly_` columns from `years`, which has one row per keys, event and year.

    The year is shifted on that side, which leaves a plain equi join that adds columns
    and never rows.
    """
    match = [*keys, "event_name", "event_year"]
    names = names or {}
    aliases = {c: names.get(c, f"ly_{c}") for c in columns}
    earlier = years.select(
        *keys,
        "event_name",
        (F.col("event_year") + 1).alias("event_year"),
        *[F.col(c).alias(a) for c, a in aliases.items()],
    )
    joined = growth.join(earlier, match, "left")
    if zero:
        joined = joined.withColumns({a: F.coalesce(a, F.lit(0)) for a in aliases.values()})
    return joined


def final_metrics(growth: DataFrame, years: DataFrame, level: Level) -> DataFrame:
    """Growth rows with last year's metrics (0 or NULL by level).

    `years` is the same comparison over whole years: one row per keys, event and year.
    """
    if level.name == "brand":
        growth = growth.filter(F.col("event_name").isNotNull())
    columns = (*PARTICIPATION.get(level.name, ()), *DEAL_METRICS, *PRE_DEAL_METRICS)
    return with_last_year(
        growth, years, level.keys, columns, level.zero_last_year, LAST_YEAR_NAMES
    )


# Report key columns, in report order.
REPORT_KEYS = {
    "item": (
        "item_id", "item_name", "category_name", "vendor_code", "company_name", "company_code",
        "brand_code", "brand_name", "event_name", "event_year", "event_month",
        "event_duration_days",
    ),
    "brand": (
        "brand_code", "brand_name", "vendor_code", "company_code", "company_name",
        "category_code", "category_name", "event_name", "event_year", "event_month",
        "promo_start_date", "promo_end_date", "event_duration_days",
    ),
    "company": (
        "company_code", "company_name", "category_code", "category_name", "event_name",
        "event_year", "event_month", "promo_start_date", "promo_end_date", "event_duration_days",
    ),
    "category": (
        "category_code", "category_name", "event_name", "event_year", "event_month",
        "event_duration_days",
    ),
    "event": (
        "event_name", "event_year", "event_month", "promo_start_date", "promo_end_date",
        "event_duration_days",
    ),
}


def _ly(columns) -> list[str]:
    return [LAST_YEAR_NAMES.get(c, f"ly_{c}") for c in columns]


def level_report(final: DataFrame, level: Level) -> DataFrame:
    """The report table of a level: keys, metrics, differences, last year.

    Brand, company and category turn every missing metric to 0: also a missing
    difference, and last year's difference is taken after that. Item and event keep
    NULLs. Year and month become text.
    """
    participation = PARTICIPATION.get(level.name, ())
    benchmark = ("pre_deal_unique_item_count",) if level.name == "event" else ()
    last_year = [*_ly(DEAL_METRICS), *_ly(PRE_DEAL_METRICS)]
    metrics = [*DEAL_METRICS, *PRE_DEAL_METRICS, *DELTAS, *last_year]
    if level.zero_last_year:
        final = final.withColumns({m: F.coalesce(m, F.lit(0)) for m in metrics})
    last_year_deltas = [
        (F.col(f"ly_daily_deal_{m}") - F.col(f"ly_daily_pre_deal_{m}")).alias(
            f"ly_delta_daily_{m}"
        )
        for m in METRICS
    ]
    return final.withColumns({
        "event_year": F.col("event_year").cast("string"),
        "event_month": F.col("event_month").cast("string"),
    }).select(
        *REPORT_KEYS[level.name], *participation, *benchmark, *metrics,
        *_ly(participation), *last_year_deltas,
    )


def sorted_report(report: DataFrame) -> DataFrame:
    """For display: latest year first, then event, then the largest daily sales."""
    return report.orderBy(
        F.col("event_year").desc_nulls_first(),
        F.col("event_name").asc_nulls_last(),
        F.col("daily_deal_ops").desc_nulls_first(),
    )


def with_yoy_delta(report: DataFrame) -> DataFrame:
    """Change of the lift: this year's difference minus last year's."""
    return report.withColumns({
        f"yoy_delta_daily_{m}": F.col(f"delta_daily_{m}") - F.col(f"ly_delta_daily_{m}")
        for m in METRICS
    })
