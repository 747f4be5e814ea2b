"""Promotions to sales events: eligibility, labels, overlaps, windows."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.titles import NO_PROMOTION, classify_event, event_priority
from ..scope import BENCHMARK_DAYS, BENCHMARK_DAYS_V1, MIN_FREQUENCY, Scope

# Statuses and types that take part, and title patterns that do not.
APPROVAL_STATUSES = ("Approved", "Scheduled")
PROMOTION_TYPES = ("Best Deal", "Deal of the Day", "Lightning Deal", "Event Deal")
EXCLUDED_TITLES = ("%OIH%", "%LEAD%")
EXCLUDED_TITLES_V1 = ("%OIH%",)

WINDOW_COLUMNS = (
    "event_name", "event_year", "event_month", "promo_start_date", "promo_end_date",
    "deal_start_date", "deal_end_date", "pre_deal_start_date", "pre_deal_end_date",
    "event_duration_days",
)


def eligible_promotions(
    promotions: DataFrame, scope: Scope, run_date: date, excluded=EXCLUDED_TITLES
) -> DataFrame:
    """Approved deals of the marketplace (of any, if the scope names none) that start within the history."""
    if scope.marketplace_id is not None:
        promotions = promotions.filter(F.col("marketplace_id") == scope.marketplace_id)
    rows = promotions.filter(
        F.col("approval_status").isin(*APPROVAL_STATUSES)
        & F.col("promotion_type").isin(*PROMOTION_TYPES)
        & (F.col("start_ts") >= F.lit(scope.first_day(run_date)))
        & (F.col("start_ts") < F.lit(run_date + timedelta(days=1)))
    )
    for pattern in excluded:
        rows = rows.filter(~F.upper("promo_title").like(pattern))
    return rows.select(
        "promotion_key",
        "promo_title",
        F.to_date("start_ts").alias("promo_start_date"),
        F.to_date("end_ts").alias("promo_end_date"),
    )


def _labelled(promotions: DataFrame, gated: bool) -> DataFrame:
    start = F.col("promo_start_date")
    label = classify_event(F.col("promo_title"), start if gated else None, F.col("promotion_key"))
    return promotions.withColumn("event_name", label)


def promo_events(
    promo_lines: DataFrame, promotions: DataFrame, items: DataFrame, scope: Scope, run_date: date
) -> DataFrame:
    """Order lines with the events they were sold in (v3), each combination once.

    Titles are matched on the promotions, before they meet the far more numerous lines. Items and
    promotions are sorted and merged: Spark would go by the compressed size of the files they come
    from, and the driver would collect many times that, growing with both.
    """
    labelled = _labelled(eligible_promotions(promotions, scope, run_date), gated=True)
    in_scope = items.filter(F.col("category_code").isin(*scope.categories))
    return (
        promo_lines.join(
            in_scope.hint("merge"), ["item_id", "marketplace_id", "region_id"], "left_semi")
        .join(labelled.hint("merge"), "promotion_key")
        .select(
            "item_id", "line_id", "promo_start_date", "promo_end_date",
            F.year("promo_start_date").alias("event_year"),
            F.month("promo_start_date").alias("event_month"),
            "event_name",
        )
        .distinct()
    )


def promo_events_v1(
    promo_lines: DataFrame, promotions: DataFrame, scope: Scope, run_date: date
) -> DataFrame:
    """As v3 without month gates or category check, with key and title; merged likewise."""
    eligible = eligible_promotions(promotions, scope, run_date, EXCLUDED_TITLES_V1)
    return (
        promo_lines.join(_labelled(eligible, gated=False).hint("merge"), "promotion_key")
        .select(
            "line_id", "item_id", "promotion_key", "promo_start_date", "promo_end_date",
            "promo_title", "event_name",
        )
        .distinct()
    )


def resolve_overlaps(events: DataFrame, keys=("item_id", "line_id")) -> DataFrame:
    """The event with the best priority, then the earliest start, per key.

    A minimum over an ordered struct combines on the map side, so a key with many
    claims never gathers its rows in one task. Ties fall to end date, event name
    and the remaining columns, which makes the choice unique.
    """
    order = ["promo_start_date", "promo_end_date", "event_name"]
    rest = [c for c in events.columns if c not in order and c not in keys]
    claim = F.struct(event_priority(F.col("event_name")).alias("priority"), *order, *rest)
    best = events.groupBy(*keys).agg(F.min(claim).alias("best"))
    return best.select(*keys, "best.*").select(*events.columns)


def standard_event_dates(events: DataFrame, min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    """Per event and year the most frequent dates, if seen `min_frequency` times."""
    counted = (
        events.filter(F.col("event_name") != NO_PROMOTION)
        .groupBy("event_name", "event_year", "event_month", "promo_start_date", "promo_end_date")
        .agg(F.count("*").alias("frequency"))
    )
    choice = F.struct(
        (-F.col("frequency")).alias("rank"),
        "promo_start_date", "promo_end_date", "event_month", "frequency",
    )
    return (
        counted.groupBy("event_name", "event_year")
        .agg(F.min(choice).alias("best"))
        .filter(F.col("best.frequency") >= min_frequency)
        .select(
            "event_name", "event_year", "best.event_month", "best.promo_start_date",
            "best.promo_end_date", "best.frequency",
        )
    )


def consolidate_promos(
    events: DataFrame, standards: DataFrame, fallback: bool = True
) -> DataFrame:
    """Replace each line's dates by the standard dates of its event and year.

    Without a standard a line keeps its own dates (v3) or, with `fallback=False`, has
    no event and no dates (v2). The standards have one row per label and year of the
    history (under a hundred), hence the broadcast.
    """
    s = F.broadcast(
        standards.select(
            F.col("event_name").alias("s_event"),
            F.col("event_year").alias("s_year"),
            F.col("event_month").alias("s_month"),
            F.col("promo_start_date").alias("s_start"),
            F.col("promo_end_date").alias("s_end"),
        )
    )
    own_year = F.year("promo_start_date") if fallback else F.col("event_year")
    joined = events.withColumn("event_year", own_year).join(
        s, (F.col("event_name") == F.col("s_event")) & (F.col("event_year") == F.col("s_year")),
        "left",
    )
    if fallback:
        joined = joined.filter(F.col("event_name") != NO_PROMOTION)
        columns = (
            F.col("event_name"),
            F.coalesce("s_month", F.month("promo_start_date")),
            F.coalesce("s_start", "promo_start_date"),
            F.coalesce("s_end", "promo_end_date"),
        )
    else:
        columns = F.col("s_event"), F.col("s_month"), F.col("s_start"), F.col("s_end")
    event, month, start, end = columns
    return joined.select(
        "item_id", "line_id", event.alias("event_name"), "event_year",
        month.alias("event_month"), start.alias("promo_start_date"), end.alias("promo_end_date"),
    )


def merge_promo_windows(events: DataFrame) -> DataFrame:
    """v1: first start and last end of a line's promotions by event, year and month."""
    return events.groupBy(
        "item_id", "line_id", "event_name",
        F.year("promo_start_date").alias("event_year"),
        F.month("promo_start_date").alias("event_month"),
    ).agg(
        F.min("promo_start_date").alias("promo_start_date"),
        F.max("promo_end_date").alias("promo_end_date"),
    )


def duration_days(start: Column, end: Column, run_date: date | None = None) -> Column:
    """Days of an event, both ends included; up to the run date if it still runs."""
    if run_date is not None:
        end = F.when(end >= F.lit(run_date), F.lit(run_date)).otherwise(end)
    return F.datediff(end, start) + 1


def benchmark_window(
    start: Column, days: int = BENCHMARK_DAYS, gap: int = 1
) -> dict[str, Column]:
    """First and last of the `days` days that end `gap` days before the start."""
    return {
        "pre_deal_start_date": F.date_sub(start, days + gap - 1),
        "pre_deal_end_date": F.date_sub(start, gap),
    }


def with_event_windows(
    promos: DataFrame, run_date: date, benchmark_days: int = BENCHMARK_DAYS, gap_days: int = 1
) -> DataFrame:
    """Deal window, benchmark window and duration of each line.

    The benchmark is the `benchmark_days` days that end `gap_days` before the deal.
    (8 days and a gap of 14 give the days from three to two weeks before.)
    """
    start, end = F.col("promo_start_date"), F.col("promo_end_date")
    return promos.withColumns({
        "deal_start_date": start,
        "deal_end_date": end,
        **benchmark_window(start, benchmark_days, gap_days),
        "event_duration_days": duration_days(start, end, run_date),
    })


def benchmark_ranges(
    promos: DataFrame, days: int = BENCHMARK_DAYS_V1, gap_days: int = 1
) -> DataFrame:
    """v1/v2: one benchmark range per item, event, year and month."""
    ranges = promos.groupBy("item_id", "event_name", "event_year", "event_month").agg(
        F.min("promo_start_date").alias("promo_start_date"),
        F.max("promo_end_date").alias("promo_end_date"),
    )
    return ranges.withColumns(benchmark_window(F.col("promo_start_date"), days, gap_days))


def item_windows(deal_lines: DataFrame) -> DataFrame:
    """The distinct windows of each item: far fewer rows than its lines."""
    return deal_lines.select("item_id", *WINDOW_COLUMNS).distinct()
