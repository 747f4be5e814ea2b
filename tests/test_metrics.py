from datetime import date, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import compare, item_growth, metrics, shares
from tidemark.operators.firsts import FLAGS
from tidemark.operators.metrics import LEVELS, METRICS
from tidemark.scope import Scope

START, END = date(2001, 6, 1), date(2001, 6, 10)
SCHEMA = (
    "item_id int, item_name string, category_code int, category_name string, brand_code string, "
    "brand_name string, vendor_code string, company_code string, company_name string, "
    "customer_id int, period_type string, event_name string, event_year int, event_month int, "
    "promo_start_date date, promo_end_date date, event_duration_days int, units int, "
    "revenue decimal(18,2), daily_subscribers double, "
    + ", ".join(f"{f} int" for f in FLAGS)
)


def line(customer, period="DEAL", item=1, brand="B", vendor="V", company="C", category=1,
         event="BSS", year=2001, month=6, units=1, revenue=10, subscribers=4.0,
         new=(1, 1, 1, 1), duration=8):
    start, end = START.replace(year=year, month=month), END.replace(year=year, month=month)
    return (
        item, f"item {item}", category, f"cat {category}", brand, brand, vendor, company, company,
        customer, period, event, year, month, start, end, duration, units, Decimal(revenue),
        subscribers, *new,
    )


def flags(spark, *lines):
    return spark.createDataFrame(list(lines), SCHEMA)


def test_item_counts_new_lines_and_uses_the_clamped_duration(spark):
    frame = flags(
        spark, line(1), line(1), line(2, new=(0, 1, 1, 1)), line(3, "PRE_DEAL"))
    row = metrics.deal_metrics(frame, LEVELS["item"]).first()
    assert row.event_duration_days == 8
    assert row.daily_deal_shipped_units == 3 / 8
    assert row.daily_deal_ops == 30 / 8
    assert row.daily_deal_customers == 2 / 8
    assert row.daily_deal_new_customers == 2 / 8  # two lines of one customer
    assert row.daily_deal_subscribers == 4.0
    assert row.deal_unique_item_count == 1


@pytest.mark.parametrize("level", ["brand", "company", "category", "event"])
def test_other_levels_count_customers_over_the_whole_window(spark, level):
    frame = flags(
        spark, line(1), line(1, item=2), line(2, new=(0, 0, 0, 0)), line(None),
        line(3, "PRE_DEAL"))
    row = metrics.deal_metrics(frame, LEVELS[level]).first()
    assert row.event_duration_days == 10
    assert row.daily_deal_customers == 2 / 10
    assert row.daily_deal_new_customers == 1 / 10


def test_any_flag_is_new_at_event_level(spark):
    frame = flags(spark, line(1, new=(0, 0, 0, 1)), line(2, item=2, brand=None, new=(0,) * 4))
    row = metrics.deal_metrics(frame, LEVELS["event"]).first()
    assert row.daily_deal_new_customers == 1 / 10
    assert (row.unique_item_count, row.unique_brand_count, row.unique_company_count) == (2, 1, 1)


def test_group_with_benchmark_orders_only(spark):
    row = metrics.deal_metrics(flags(spark, line(1, "PRE_DEAL")), LEVELS["brand"]).first()
    assert (row.daily_deal_shipped_units, row.daily_deal_ops, row.daily_deal_subscribers) == (
        None, None, None)
    assert (row.daily_deal_customers, row.daily_deal_new_customers) == (0, 0)


def test_required_keys(spark):
    frame = flags(spark, line(1, brand=None), line(1, company=None))
    assert metrics.deal_metrics(frame, LEVELS["brand"]).count() == 1
    assert metrics.deal_metrics(frame, LEVELS["company"]).count() == 1
    assert metrics.deal_metrics(frame, LEVELS["item"]).count() == 2


def test_benchmark_metrics(spark):
    frame = flags(
        spark, *[line(c, "PRE_DEAL", units=10) for c in range(6)], line(9, event="NYNY"))
    row = metrics.pre_deal_metrics(frame, LEVELS["brand"]).collect()
    assert len(row) == 1 and row[0].daily_pre_deal_shipped_units == 60 / 29
    whole = metrics.pre_deal_metrics(frame, LEVELS["brand"], integer_daily=True).first()
    assert (whole.daily_pre_deal_shipped_units, whole.daily_pre_deal_customers) == (2, 0)
    assert whole.daily_pre_deal_ops == 60 / 29
    by_event = metrics.pre_deal_metrics(frame, LEVELS["event"])
    assert rows(by_event, "event_name", "pre_deal_unique_item_count") == [("BSS", 1), ("NYNY", 0)]


def reports(spark, level, *lines):
    frame, spec = flags(spark, *lines), LEVELS[level]
    growth = compare.deal_vs_benchmark(
        metrics.deal_metrics(frame, spec), metrics.pre_deal_metrics(frame, spec), spec)
    years = compare.deal_vs_benchmark(
        metrics.deal_metrics(frame, spec, whole_year=True), metrics.pre_deal_metrics(frame, spec),
        spec)
    final = compare.final_metrics(growth, years, spec)
    return growth, final, compare.level_report(final, spec)


def test_no_benchmark_gives_null_or_zero_delta(spark):
    growth, _, report = reports(spark, "brand", line(1))
    assert growth.first().delta_daily_ops is None
    assert report.first().delta_daily_ops == 0
    _, _, report = reports(spark, "item", line(1))
    assert report.first().delta_daily_ops is None


def test_last_year_is_one_row_whatever_its_months(spark):
    lines = [line(1), line(1, month=7), line(1, year=2000), line(1, year=2000, month=7)]
    for level in LEVELS:
        growth, final, _ = reports(spark, level, *lines)
        assert final.count() == growth.count() == 4
        this_year = final.filter("event_year = 2001").collect()
        assert len({r.ly_daily_deal_shipped_units for r in this_year}) == 1
        assert this_year[0].ly_daily_deal_shipped_units is not None


def test_missing_last_year(spark):
    for level, value in (("brand", 0), ("company", 0), ("category", 0), ("item", None),
                         ("event", None)):
        _, final, report = reports(spark, level, line(1), line(1, "PRE_DEAL"))
        assert final.first().ly_daily_deal_ops == value
        assert report.first().ly_delta_daily_ops == value


def test_reports_have_text_years_and_every_metric(spark):
    for level, spec in LEVELS.items():
        _, _, report = reports(spark, level, line(1), line(1, "PRE_DEAL"), line(1, year=2000))
        kinds = dict(report.dtypes)
        assert kinds["event_year"] == kinds["event_month"] == "string"
        for m in METRICS:
            assert {f"daily_deal_{m}", f"daily_pre_deal_{m}", f"delta_daily_{m}",
                    f"ly_daily_deal_{m}", f"ly_daily_pre_deal_{m}",
                    f"ly_delta_daily_{m}"} <= set(report.columns)
        assert report.columns[: len(compare.REPORT_KEYS[level])] == list(compare.REPORT_KEYS[level])
        years = [r.event_year for r in compare.sorted_report(report).collect()]
        assert years == sorted(years, reverse=True)


def test_yoy_delta(spark):
    lines = [line(1, revenue=30), line(1, "PRE_DEAL", revenue=29), line(1, year=2000, revenue=20),
             line(1, "PRE_DEAL", year=2000, revenue=29)]
    _, _, report = reports(spark, "brand", *lines)
    row = compare.with_yoy_delta(report).filter("event_year = '2001'").first()
    assert row.yoy_delta_daily_ops == pytest.approx((30 / 10 - 1) - (20 / 10 - 1))


def test_deal_keys(spark):
    frame = flags(spark, line(1), line(2), line(1, "PRE_DEAL", brand="X"))
    assert rows(metrics.deal_keys(frame, LEVELS["brand"])) == [("B", "BSS", 2001)]


def test_shares_peers_and_lift(spark):
    frame = flags(
        spark,
        line(1, brand="A"), line(2, brand="A", new=(0,) * 4),  # A: 0.5
        line(3, brand="B"),  # B: 1
        line(4, brand="D", new=(0,) * 4), line(5, brand="E", new=(0,) * 4),  # D, E: 0
        line(6, "PRE_DEAL", brand="A", new=(0,) * 4),
    )
    share = shares.new_customer_share(frame, LEVELS["brand"], ("category_code",))
    deal = share.filter("period_type = 'DEAL'")
    assert rows(deal, "brand_code", "new_share") == [
        ("A", 0.5), ("B", 1.0), ("D", 0.0), ("E", 0.0)]
    assert [r.brand_code for r in shares.top_new_share(share, 2).collect()] == ["B", "A"]
    peers = shares.peer_comparison(share).filter("period_type = 'DEAL'")
    assert rows(peers, "brand_code", "peer_percent_rank") == [
        ("A", 2 / 3), ("B", 1.0), ("D", 0.0), ("E", 0.0)]
    assert peers.filter(F.abs(F.col("peer_mean_share") - 0.375) > 1e-12).count() == 0
    lift = shares.new_share_lift(share)
    assert rows(lift.filter("brand_code = 'A'"), "new_share_lift") == [(0.5,)]


def test_v1_new_and_returning_customers(spark):
    schema = (
        "item_id int, item_name string, category_code int, brand_code string, brand_name string, "
        "event_name string, promo_start_date date, promo_end_date date, customer_id int, "
        "is_first_brand_purchase int, units int, revenue double, ads_amt double, "
        "subscription_amt double"
    )

    def sale(customer, first, item=1, brand="B"):
        return (item, "i", 1, brand, brand, "BSS", START, END, customer, first, 2, 5.0, 1.0, 0.5)

    summary = spark.createDataFrame(
        [sale(1, 1), sale(1, 0), sale(2, 1), sale(3, 0, item=2), sale(4, 0, brand=None)], schema)
    vendors = spark.createDataFrame(
        [(1, "V1", 7, 1), (1, "V2", 7, 1), (2, "V1", 1, 1)],
        "item_id int, vendor_code string, marketplace_id int, region_id int")
    deal = item_growth.deal_metrics_v1(summary, vendors, Scope({}), date(2001, 8, 1))
    one = deal.filter("item_id = 1 and brand_code = 'B'")
    assert rows(one, "vendor_code") == [("V1",), ("V2",)]
    row = one.first()
    assert (row.daily_deal_total_customers_item, row.daily_deal_new_customers_item,
            row.daily_deal_return_customers_item) == (0.2, 0.2, 0.1)
    assert (row.daily_deal_total_customers_brand, row.daily_deal_return_customers_brand) == (
        0.3, 0.2)
    assert deal.filter("brand_code is null").first().daily_deal_total_customers_brand is None
    assert deal.filter("item_id = 2").first().vendor_code is None


def test_entities_without_a_share_stay_among_their_peers(spark):
    share = spark.createDataFrame(
        [("a", None, 4, 1, 0.25), ("b", None, 4, 3, 0.75), ("c", None, 0, 0, None),
         ("d", 1, 0, 0, None)],
        "brand_code string, category_code int, customers int, new_customers int, new_share double"
    ).selectExpr("*", "'BSS' AS event_name", "2001 AS event_year", "'DEAL' AS period_type")
    got = shares.peer_comparison(share)
    assert rows(got, "brand_code", "peer_mean_share", "share_vs_peers", "peer_percent_rank") == [
        ("a", 0.5, -0.25, 0.0), ("b", 0.5, 0.25, 1.0), ("c", 0.5, None, None),
        ("d", None, None, None)]


def test_v1_subscribers_weigh_lines(spark):
    subscriptions = spark.createDataFrame(
        [(1, date(2001, 6, 1), 10, 7, 1, 75), (1, date(2001, 6, 1), 20, 7, 1, 75),
         (1, date(2001, 6, 12), 40, 7, 1, 75), (1, date(2001, 3, 2), 7, 7, 1, 75),
         (1, date(2001, 3, 1), 999, 7, 1, 75), (2, date(2000, 1, 1), 5, 7, 1, 75)],
        "item_id int, snapshot_date date, active_subscribers long, marketplace_id int, "
        "region_id int, category_code int")
    promos = spark.createDataFrame(
        [(1, "a", "BSS", START, END), (1, "b", "BSS", START, END),
         (1, "c", "BSS", START, date(2001, 6, 12)), (2, "d", "BSS", START, END),
         (3, "e", "BSS", START, END)],
        "item_id int, line_id string, event_name string, promo_start_date date, "
        "promo_end_date date")
    got = item_growth.subscriber_metrics_v1(subscriptions, promos, Scope({75: "Baby"}))
    expected = (3 * 30 + 40) / 7  # three lines x two snapshots, one line x one more
    assert rows(got, "item_id", "avg_deal_subscribers", "avg_pre_deal_subscribers") == [
        (1, expected, 7.0), (2, None, None)]


day_numbers = st.integers(0, 400)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from([1, 2]), day_numbers, st.none() | st.integers(0, 9)), max_size=30),
    st.lists(st.tuples(st.sampled_from([1, 2, 3]), day_numbers, st.integers(-3, 120)), min_size=1,
             max_size=10),
)
def test_sums_up_to_each_day_equal_filtering(spark, snapshots, windows):
    first = date(2000, 1, 1)
    table = spark.createDataFrame(
        [(i, first + timedelta(d), n, 7, 1, 1) for i, d, n in snapshots],
        "item_id int, snapshot_date date, active_subscribers long, marketplace_id int, "
        "region_id int, category_code int")
    promos = spark.createDataFrame(
        [(i, "BSS", first + timedelta(d), first + timedelta(d + length)) for i, d, length in windows],
        "item_id int, event_name string, promo_start_date date, promo_end_date date")
    expected = {}
    for item, day, length in windows:
        own = [(d, n) for i, d, n in snapshots if i == item]
        if own:
            deal, pre = expected.setdefault((item, first + timedelta(day)), ([], []))
            deal += [n for d, n in own if day <= d <= day + length and n is not None]
            pre += [n for d, n in own if day - 91 <= d < day and n is not None]
    found = item_growth.subscriber_metrics_v1(table, promos, Scope({1: "One"}))

    def mean(numbers):
        return round(sum(numbers) / len(numbers), 9) if numbers else None

    got = {(r.item_id, r.promo_start_date): tuple(
        None if x is None else round(x, 9) for x in (r.avg_deal_subscribers, r.avg_pre_deal_subscribers))
        for r in found.collect()}
    assert got == {k: (mean(a), mean(b)) for k, (a, b) in expected.items()}


def test_windows_filter_no_days(spark):
    """Two look-ups a window: the plan has no filter over the days of an item."""
    table = spark.createDataFrame(
        [(1, date(2001, 1, 1), 3, 7, 1, 1)], "item_id int, snapshot_date date, active_subscribers long, "
        "marketplace_id int, region_id int, category_code int")
    promos = spark.createDataFrame(
        [(1, "BSS", date(2001, 1, 1), date(2001, 1, 2))],
        "item_id int, event_name string, promo_start_date date, promo_end_date date")
    text = item_growth.subscriber_metrics_v1(
        table, promos, Scope({1: "One"}))._jdf.queryExecution().optimizedPlan().toString()
    assert "upto" in text and "filter(upto" not in text and "aggregate(" not in text


def test_days_without_snapshots_take_no_room(spark):
    """Two snapshots 27 years apart are two rows: no day between them is filled, no row gathers all."""
    table = spark.createDataFrame(
        [(1, date(1974, 1, 1), 3, 7, 1, 1), (1, date(2001, 1, 2), 5, 7, 1, 1)],
        "item_id int, snapshot_date date, active_subscribers long, marketplace_id int, "
        "region_id int, category_code int")
    promos = spark.createDataFrame(
        [(1, "BSS", date(2001, 1, 1), date(2001, 1, 2)), (1, "BSS", None, date(2001, 1, 2)),
         (1, "late", date(2001, 1, 3), None), (2, "none", date(2001, 1, 1), date(2001, 1, 2))],
        "item_id int, event_name string, promo_start_date date, promo_end_date date")
    found = item_growth.subscriber_metrics_v1(table, promos, Scope({1: "One"}))
    assert rows(found, "event_name", "avg_deal_subscribers", "avg_pre_deal_subscribers") == [
        ("BSS", None, None), ("BSS", 5.0, None), ("late", None, 5.0)]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" not in text and "collect_list" not in text
