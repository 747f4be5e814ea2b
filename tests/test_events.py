from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import events
from tidemark.scope import Scope

RUN = date(2001, 8, 1)
EVENT_SCHEMA = (
    "item_id int, line_id string, promo_start_date date, promo_end_date date, event_year int, "
    "event_month int, event_name string"
)


def event(item, line, name, start, end):
    return (item, line, start, end, start.year, start.month, name)


def frame(spark, *events_):
    return spark.createDataFrame(list(events_), EVENT_SCHEMA)


def test_eligible_promotions(spark):
    def promo(key, **changes):
        row = {
            "promotion_key": key, "promo_title": "Deal", "start_ts": datetime(2001, 1, 1),
            "end_ts": datetime(2001, 1, 9), "marketplace_id": 7, "approval_status": "Approved",
            "promotion_type": "Best Deal",
        }
        return tuple((row | changes).values())

    promotions = spark.createDataFrame([
        promo(1),
        promo(2, approval_status="Scheduled", promotion_type="Event Deal"),
        promo(3, approval_status="Draft"),
        promo(4, promotion_type="Coupon"),
        promo(5, marketplace_id=1),
        promo(6, promo_title="oih clearance"),
        promo(7, promo_title="Lead in"),
        promo(8, promo_title=None),
        promo(9, start_ts=datetime(1999, 8, 2)),  # first day of the history
        promo(10, start_ts=datetime(1999, 8, 1, 23)),
        promo(11, start_ts=datetime(2001, 8, 1, 23)),  # any time of the run date
        promo(12, start_ts=datetime(2001, 8, 2)),
    ], "promotion_key long, promo_title string, start_ts timestamp_ntz, end_ts timestamp_ntz, "
       "marketplace_id int, approval_status string, promotion_type string")
    v3 = events.eligible_promotions(promotions, Scope({}), RUN)
    assert [r[0] for r in rows(v3, "promotion_key")] == [1, 2, 9, 11]
    v1 = events.eligible_promotions(promotions, Scope({}), RUN, events.EXCLUDED_TITLES_V1)
    assert [r[0] for r in rows(v1, "promotion_key")] == [1, 2, 7, 9, 11]
    anywhere = events.eligible_promotions(promotions, Scope({}, marketplace_id=None), RUN)
    assert [r[0] for r in rows(anywhere, "promotion_key")] == [1, 2, 5, 9, 11]


def test_overlaps_take_priority_then_start(spark):
    claims = frame(
        spark,
        event(1, "a", "CYBER MONDAY", date(2000, 11, 20), date(2000, 12, 2)),
        event(1, "a", "BLACK FRIDAY", date(2000, 11, 25), date(2000, 11, 30)),
        event(1, "a", "OTHER", date(2000, 1, 1), date(2000, 12, 31)),
        event(1, "b", "DIWALI", date(2000, 10, 5), date(2000, 10, 9)),
        event(1, "b", "OTHER", date(2000, 10, 4), date(2000, 10, 9)),
        event(2, "c", "BSS", date(2000, 3, 1), date(2000, 3, 5)),
        event(2, "c", "BSS", date(2000, 3, 1), date(2000, 3, 4)),
    )
    best = events.resolve_overlaps(claims)
    assert best.columns == claims.columns
    assert rows(best, "line_id", "event_name", "promo_end_date") == [
        ("a", "BLACK FRIDAY", date(2000, 11, 30)),
        ("b", "OTHER", date(2000, 10, 9)),
        ("c", "BSS", date(2000, 3, 4)),
    ]
    monthly = events.resolve_overlaps(claims, ("item_id", "event_month"))
    assert rows(monthly, "item_id", "event_month", "line_id") == [
        (1, 1, "a"), (1, 10, "b"), (1, 11, "a"), (2, 3, "c"),
    ]


def test_standard_dates_frequency_and_ties(spark):
    def lines(n, name, start, end):
        return [event(1, f"{name}{start}{i}", name, start, end) for i in range(n)]

    standards = events.standard_event_dates(frame(
        spark,
        *lines(3, "BSS", date(2000, 3, 20), date(2000, 3, 25)),
        *lines(2, "BSS", date(2000, 4, 1), date(2000, 4, 5)),
        *lines(2, "DIWALI", date(2000, 10, 1), date(2000, 10, 5)),  # too few
        *lines(3, "NYNY", date(2000, 1, 2), date(2000, 1, 5)),  # tie: earlier start
        *lines(3, "NYNY", date(2000, 1, 1), date(2000, 1, 5)),
        *lines(4, "NYNY", date(2001, 1, 3), date(2001, 1, 5)),  # its own year
    ))
    assert rows(standards, "event_name", "event_year", "promo_start_date", "frequency") == [
        ("BSS", 2000, date(2000, 3, 20), 3),
        ("NYNY", 2000, date(2000, 1, 1), 3),
        ("NYNY", 2001, date(2001, 1, 3), 4),
    ]


def test_consolidation_with_and_without_fallback(spark):
    own = frame(
        spark,
        event(1, "a", "BSS", date(2000, 3, 1), date(2000, 3, 5)),
        event(1, "b", "DIWALI", date(2000, 10, 1), date(2000, 10, 5)),
        event(1, "c", "NO_PROMOTION", date(2000, 10, 1), date(2000, 10, 5)),
    )
    standards = spark.createDataFrame(
        [("BSS", 2000, 4, date(2000, 4, 1), date(2000, 4, 9), 3)],
        "event_name string, event_year int, event_month int, promo_start_date date, "
        "promo_end_date date, frequency long",
    )
    columns = ("line_id", "event_name", "event_month", "promo_start_date")
    assert rows(events.consolidate_promos(own, standards), *columns) == [
        ("a", "BSS", 4, date(2000, 4, 1)), ("b", "DIWALI", 10, date(2000, 10, 1)),
    ]
    strict = events.consolidate_promos(own, standards, fallback=False)
    assert rows(strict, *columns) == [
        ("a", "BSS", 4, date(2000, 4, 1)), ("b", None, None, None), ("c", None, None, None),
    ]


@pytest.mark.parametrize("start, end, duration", [
    (date(2001, 7, 1), date(2001, 7, 10), 10),  # over
    (date(2001, 7, 1), RUN, 32),  # ends today
    (date(2001, 7, 1), date(2001, 9, 1), 32),  # still running
    (date(2001, 7, 1), date(2001, 7, 1), 1),
])
def test_event_windows(spark, start, end, duration):
    windows = events.with_event_windows(frame(spark, event(1, "a", "BSS", start, end)), RUN)
    row = windows.first()
    assert row.event_duration_days == duration
    assert (start - row.pre_deal_start_date).days == 29
    assert (start - row.pre_deal_end_date).days == 1


def test_benchmark_two_to_three_weeks_before(spark):
    own = frame(spark, event(1, "a", "BSS", date(2001, 7, 31), date(2001, 7, 31)))
    row = events.with_event_windows(own, RUN, benchmark_days=8, gap_days=14).first()
    assert (row.pre_deal_start_date, row.pre_deal_end_date) == (
        date(2001, 7, 10), date(2001, 7, 17))


def test_merged_windows_and_ranges(spark):
    own = frame(
        spark,
        event(1, "a", "BSS", date(2001, 3, 5), date(2001, 3, 9)),
        event(1, "a", "BSS", date(2001, 3, 2), date(2001, 3, 6)),
        event(1, "a", "BSS", date(2001, 4, 1), date(2001, 4, 2)),
        event(1, "b", "BSS", date(2001, 3, 1), date(2001, 3, 3)),
    )
    merged = events.merge_promo_windows(own)
    assert rows(merged, "line_id", "event_month", "promo_start_date", "promo_end_date") == [
        ("a", 3, date(2001, 3, 2), date(2001, 3, 9)),
        ("a", 4, date(2001, 4, 1), date(2001, 4, 2)),
        ("b", 3, date(2001, 3, 1), date(2001, 3, 3)),
    ]
    ranges = events.benchmark_ranges(merged)
    assert rows(ranges, "event_month", "promo_start_date", "promo_end_date") == [
        (3, date(2001, 3, 1), date(2001, 3, 9)), (4, date(2001, 4, 1), date(2001, 4, 2)),
    ]
    assert ranges.filter(F.datediff("promo_start_date", "pre_deal_start_date") != 91).count() == 0


def test_item_windows_drop_lines(spark):
    own = frame(
        spark,
        event(1, "a", "BSS", date(2001, 3, 1), date(2001, 3, 3)),
        event(1, "b", "BSS", date(2001, 3, 1), date(2001, 3, 3)),
    )
    assert events.item_windows(events.with_event_windows(own, RUN)).count() == 1
