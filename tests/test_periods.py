from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import events, firsts, periods, prefilter

RUN = date(2001, 8, 1)
START, END = date(2001, 6, 1), date(2001, 6, 10)
BASE = (
    "item_id int, customer_id int, line_id string, order_date date, units int, brand_code string, "
    "company_code string, category_code int"
)


def order(line, day, item=1, customer=1, brand="B", company="C", category=1):
    return (item, customer, line, day, 1, brand, company, category)


def base(spark, *orders):
    return spark.createDataFrame(list(orders), BASE)


def deal_lines(spark, lines, start=START, end=END, item=1, name="BSS"):
    own = spark.createDataFrame(
        [(item, line, name, start.year, start.month, start, end) for line in lines],
        "item_id int, line_id string, event_name string, event_year int, event_month int, "
        "promo_start_date date, promo_end_date date",
    )
    return events.with_event_windows(own, RUN)


def test_period_boundaries(spark):
    days = {
        "before": START - timedelta(30), "first": START - timedelta(29),
        "last": START - timedelta(1), "start": START, "end": END, "after": END + timedelta(1),
        "other": START,
    }
    orders = base(spark, *[order(name, day) for name, day in days.items()])
    deal = deal_lines(spark, [n for n in days if n != "other"])
    matched = periods.match_periods(deal, events.item_windows(deal), orders)
    assert rows(matched, "period_type", "line_id") == [
        ("DEAL", "end"), ("DEAL", "start"), ("PRE_DEAL", "first"), ("PRE_DEAL", "last"),
    ]


def test_an_order_counts_in_several_benchmarks(spark):
    orders = base(spark, order("a", START - timedelta(1)))
    deal = deal_lines(spark, ["x"]).union(
        deal_lines(spark, ["y"], START + timedelta(5), END, name="NYNY")
    )
    matched = periods.match_pre_deal(events.item_windows(deal), orders)
    assert rows(matched, "event_name") == [("BSS",), ("NYNY",)]


def test_subscribers_default_to_zero(spark):
    orders = base(spark, order("a", START), order("b", START + timedelta(1)))
    subscribers = spark.createDataFrame(
        [(1, START, 2.5)], "item_id int, metric_date date, daily_subscribers double")
    got = periods.with_subscribers(orders, subscribers)
    assert rows(got, "line_id", "daily_subscribers") == [("a", 2.5), ("b", 0.0)]


def flagged(spark, *orders, **options):
    """Flags of a deal on line "deal" at START, given other orders as history."""
    null_keys = options.pop("null_keys_are_new", True)
    frame = base(spark, *orders)
    deal = deal_lines(spark, ["deal"])
    levels = firsts.first_purchase_levels(frame, RUN, **options)
    flags = firsts.flag_new_by_period(periods.match_deal(deal, frame), levels, null_keys)
    assert flags.count() == 1
    return tuple(flags.select(*firsts.FLAGS).first())


def test_flags_by_level(spark):
    earlier = START - timedelta(40)
    assert flagged(spark, order("deal", START)) == (1, 1, 1, 1)
    other_item = order("x", earlier, item=2)
    assert flagged(spark, order("deal", START), other_item) == (1, 0, 0, 0)
    other_brand = order("x", earlier, item=2, brand="B2")
    assert flagged(spark, order("deal", START), other_brand) == (1, 1, 0, 0)
    other_company = order("x", earlier, item=2, brand="B2", company="C2")
    assert flagged(spark, order("deal", START), other_company) == (1, 1, 1, 0)
    other_category = order("x", earlier, item=2, brand="B2", category=2)
    assert flagged(spark, order("deal", START), other_category) == (1, 1, 1, 1)
    other_customer = order("x", earlier, customer=2)
    assert flagged(spark, order("deal", START), other_customer) == (1, 1, 1, 1)


def test_lookback(spark):
    old = order("x", RUN - timedelta(366))
    assert flagged(spark, order("deal", START), old) == (1, 1, 1, 1)
    assert flagged(spark, order("deal", START), old, lookback_days=None) == (0, 0, 0, 0)
    at_edge = order("x", RUN - timedelta(365))
    assert flagged(spark, order("deal", START), at_edge) == (0, 0, 0, 0)


def test_null_keys(spark):
    deal = order("deal", START, brand=None)
    old = order("x", START - timedelta(40), brand=None)
    assert flagged(spark, deal, old) == (1, 1, 1, 1)
    assert flagged(spark, deal, old, null_keys_are_new=False) == (0, 0, 0, 0)


def test_flags_v1_by_date(spark):
    orders = base(
        spark, order("a", START), order("b", START), order("c", END), order("n", END, brand=None))
    flags = firsts.flag_new_by_date(orders, firsts.first_purchases(orders))
    assert rows(flags, "line_id", "is_first_brand_purchase") == [
        ("a", 1), ("b", 1), ("c", 0), ("n", 0)]


purchases = st.lists(
    st.tuples(
        st.integers(1, 3), st.sampled_from([1, 2, None]), st.integers(0, 300),
        st.sampled_from(["B1", "B2", None]), st.sampled_from(["C1", None]), st.integers(1, 2),
    ),
    min_size=1, max_size=25,
)


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(purchases)
def test_first_purchases_equal_plain_minima(spark, drawn):
    frame = base(spark, *[
        (item, customer, str(i), RUN - timedelta(day), 1, brand, company, category)
        for i, (item, customer, day, brand, company, category) in enumerate(drawn)
    ])
    got = {tuple(r)[:5]: tuple(r)[5:] for r in firsts.first_purchase_levels(frame, RUN).collect()}
    days = {}
    for item, customer, day, brand, company, category in drawn:
        keys = (customer, item, brand, company, category)
        for part in ((0, 1), (0, 2), (0, 3, 4), (0, 4)):
            level = (part, *(keys[i] for i in part))
            days[level] = min(days.get(level, RUN), RUN - timedelta(day))
    for keys, firsts_ in got.items():
        assert firsts_ == tuple(days[part, *(keys[i] for i in part)]
                                for part in ((0, 1), (0, 2), (0, 3, 4), (0, 4)))
    assert got.keys() == {(c, i, b, k, g) for i, c, _, b, k, g in drawn}
    late = firsts.first_purchase_levels(frame, RUN).filter(
        F.col("first_brand_purchase") > F.col("first_item_purchase"))
    if all(b for *_, b, _, _ in drawn):
        assert late.filter("first_category_purchase > first_company_purchase").count() == 0


WINDOW = ("item_id int, event_name string, event_year int, event_month int, promo_start_date date, "
          "promo_end_date date, deal_start_date date, deal_end_date date, "
          "pre_deal_start_date date, pre_deal_end_date date, event_duration_days int")


def window(item, start, days=29, name="BSS"):
    """A window whose benchmark begins on a day of the two years before the run date."""
    first = None if start is None else RUN - timedelta(730 - start)
    last = None if start is None else first + timedelta(days - 1)
    return (item, name, 2001, 1, RUN, RUN, RUN, RUN, first, last, 1)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from([1, 2, None]), st.integers(0, 730) | st.none()), max_size=12),
    st.lists(st.tuples(st.sampled_from([1, 2, 3, None]), st.integers(0, 700) | st.none(),
                       st.integers(1, 100)), max_size=6),
    st.sampled_from([1, 8, 29, 91, 1000]),
)
def test_date_bins_change_no_rows(spark, orders_, windows_, bin_days):
    days = [None if d is None else RUN - timedelta(730 - d) for _, d in orders_]
    orders = base(spark, *[order(str(i), day, item) for i, ((item, _), day) in enumerate(
        zip(orders_, days))]) if orders_ else spark.createDataFrame([], BASE)
    windows = spark.createDataFrame(
        [window(i, s, d, str(n)) for n, (i, s, d) in enumerate(windows_)], WINDOW)
    expected = sorted(
        (str(o), str(n)) for o, ((item, _), day) in enumerate(zip(orders_, days))
        for n, (i, s, d) in enumerate(windows_)
        if None not in (item, day, s) and item == i
        and 0 <= (day - (RUN - timedelta(730 - s))).days < d)
    found = periods.in_windows(orders, windows, bin_days)
    assert rows(found, "line_id", "event_name") == expected


def test_orders_meet_the_windows_of_their_own_weeks(spark):
    """Two years of orders and a benchmark in most weeks: few pairs fail the dates."""
    orders = base(spark, *[
        order(f"{item}-{d}", RUN - timedelta(d), item) for item in range(5) for d in range(730)])
    windows = spark.createDataFrame(
        [window(item, start, 29, f"{start}") for item in range(5) for start in range(3, 700, 17)],
        WINDOW)
    pairs = periods.same_bin(orders, windows, 29).count()
    found = periods.in_windows(orders, windows, 29).count()
    assert found > 5000
    assert pairs <= 3 * found
    assert orders.join(windows, "item_id").count() > 10 * pairs


def test_orders_of_items_without_a_window_are_not_shuffled(spark):
    orders = spark.range(20_000).select(
        (F.col("id") % 2000).cast("int").alias("item_id"),
        F.col("id").cast("string").alias("line_id"), F.lit(RUN).alias("order_date"))
    windows = spark.createDataFrame([window(item, 730) for item in range(7)], WINDOW)
    kept = prefilter.keep_marked(orders, ["item_id"], prefilter.key_filter(windows, ["item_id"]))
    assert 70 <= kept.count() <= 140
    matched = periods.in_windows(orders, windows, 29)
    assert matched.count() == 70
    text = matched._jdf.queryExecution().executedPlan().toString()
    # the filter's broadcast join lies below the exchange of the orders
    below = text[text.rindex("hashpartitioning(item_id"):]
    assert "_word" in below and "BroadcastHashJoin" in below


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50) | st.none(), max_size=30), st.sampled_from([64, 1 << 24]))
def test_a_key_filter_keeps_all_that_match(spark, keys, slots):
    rows_ = spark.range(-50, 51).select(F.col("id").alias("key"))
    marked = spark.createDataFrame([(k,) for k in keys], "key long")
    marks = prefilter.key_filter(marked, ["key"], slots)
    kept = {r[0] for r in prefilter.keep_marked(rows_, ["key"], marks, slots).collect()}
    assert marks.count() <= slots // 64 and {k for k in keys if k is not None} <= kept
    if slots > 64:
        assert kept == {k for k in keys if k is not None}
