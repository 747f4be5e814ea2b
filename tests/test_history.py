from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tidemark.functions import bucket_labels
from tidemark.operators import cohorts, history
from tidemark.sources import load_testdata

SCHEMA = (
    "vendor_code string, item_id int, customer_id int, order_ts timestamp_ntz, "
    "condition_code int, line_id string"
)
DAY = datetime(2001, 1, 20, 9)


def orders(spark, *lines):
    return spark.createDataFrame(list(lines), SCHEMA)


def line(number, ts, customer=1, item=1, vendor="V", condition=1):
    return (vendor, item, customer, ts, condition, f"{number:04d}")


def brute_force(lines):
    """History by sorting each customer's lines in plain Python."""
    groups = {}
    for vendor, item, customer, ts, condition, number in lines:
        if vendor not in (None, "NaN") and condition not in (None, 6):
            groups.setdefault((vendor, customer), []).append((ts, number, item))
    result = []
    for (vendor, customer), found in groups.items():
        times, before = [], (None, None)
        for ts, _, item in sorted(found, key=lambda r: (r[0] is not None, r[0] or DAY, r[1])):
            if not times or times[-1] != ts:
                times.append(ts)
            result.append((vendor, item, customer, ts, *before, len(times)))
            before = (ts, item)
    return result


COLUMNS = (
    "vendor_code", "item_id", "customer_id", "order_ts", "last_order_ts", "last_item_id",
    "purchase_rank",
)


def test_filters_ties_and_ranks(spark):
    lines = [
        line(1, DAY), line(2, DAY, item=2), line(3, DAY + timedelta(1), item=3),
        line(4, DAY, vendor="NaN"), line(5, DAY, vendor=None), line(6, DAY, condition=6),
        line(7, DAY, condition=None), line(8, DAY, customer=2),
    ]
    got = history.purchase_history(orders(spark, *lines))
    assert rows(got, "customer_id", "item_id", "last_item_id", "purchase_rank") == [
        (1, 1, None, 1), (1, 2, 1, 1), (1, 3, 2, 2), (2, 1, None, 1)]


drawn_lines = st.lists(
    st.tuples(
        st.sampled_from(["V", "W", "NaN"]), st.integers(1, 4), st.sampled_from([1, 2, None]),
        st.integers(0, 30), st.sampled_from([1, 1, 6]),
    ),
    min_size=1, max_size=40,
)


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(drawn_lines)
def test_hour_by_hour_equals_whole_customers(spark, drawn):
    lines = [
        (vendor, item, customer, DAY + timedelta(minutes=20 * step), condition, f"{i:04d}")
        for i, (vendor, item, customer, step, condition) in enumerate(drawn)
    ]
    frame = orders(spark, *lines)
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    expected = sorted(brute_force(lines), key=key)
    for chunk_rows in (1, 3, 1000):
        got = history.purchase_history(frame, chunk_rows=chunk_rows)
        assert rows(got, *COLUMNS) == expected, chunk_rows


def test_one_customer_with_most_rows_all_at_midnight(spark):
    lines = [("V", i % 7, 1, DAY + timedelta(days=i % 3), 1, f"{i * 7919 % 4000:04d}")
             for i in range(3000)]
    lines += [("V", i, 2 + i, DAY, 1, f"x{i}") for i in range(50)]
    lines += [("V", 1, None, DAY, 1, "n1"), ("V", 2, None, None, 1, "n2"), ("V", 3, 1, None, 1, "n3")]
    frame = orders(spark, *lines)
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    assert rows(history.purchase_history(frame), *COLUMNS) == sorted(brute_force(lines), key=key)


@pytest.mark.parametrize("line_id", [
    "id * 7919 % 6007", "concat('order-2001-', lpad(id * 7919 % 6007, 8, '0'))",
    "concat(if(id = 5, 'A', 'zzzzzzzz'), id)", "'same'", "cast(null as string)",
], ids=["numbers", "common prefix", "one other prefix", "equal", "null"])
def test_a_day_of_one_customer_is_split_into_even_ranges(spark, line_id):
    """One customer with most rows and one date: chunks stay bounded and nothing changes."""
    frame = spark.range(6000).selectExpr(
        "'V' AS vendor_code", "cast(id % 7 as int) AS item_id",
        "cast(if(id < 5900, 1, id) as int) AS customer_id",
        "timestamp_ntz'2001-01-20 00:00:00' AS order_ts", "1 AS condition_code",
        f"{line_id} AS line_id")
    got = history.purchase_history(frame, chunk_rows=100).collect()
    lines = [tuple(r) for r in frame.collect()]
    same = lines[0][5] in ("same", None)
    if not same:
        key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
        ordered = sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key)
        assert ordered == sorted(brute_force(lines), key=key)
    assert len(got) == 6000 and {r.purchase_rank for r in got} == {1}
    assert sum(r.last_order_ts is None for r in got) == 101
    rows_ = frame.selectExpr(
        "item_id", "order_ts", "line_id",
        "struct(struct(vendor_code, customer_id) AS customer, date_trunc('hour', order_ts) AS hour)"
        " AS block")
    ranges = history._ranges(rows_, 100).withColumnRenamed("block", "of_block")
    sizes = [r["count"] for r in rows_.join(
        ranges, rows_["block"] == ranges["of_block"]).groupBy(
        history._range_of("cuts").alias("range")).count().collect()]
    assert sum(sizes) == 5900
    assert (len(sizes) > 5 and max(sizes) < 1200) if same else (len(sizes) > 40 and max(sizes) < 400)


def test_whole_and_chunked_customers_with_nulls_and_repeated_rows(spark):
    """Customers at both sides of the limit: missing times and customers, rows that come twice."""
    lines = [line(i, DAY + timedelta(hours=i % 9), customer, item=i % 3)
             for customer, n in ((1, 4), (2, 5), (3, 6), (4, 40), (None, 3)) for i in range(n)]
    lines += [line(90, None, 1), line(91, None, 4), line(92, None, 4, item=2), line(93, None, None)]
    lines += [line(i, DAY + timedelta(days=i), None, vendor="W") for i in range(12)]
    lines += lines[:5] + lines[20:30]
    frame = orders(spark, *lines)
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    expected = sorted(brute_force(lines), key=key)
    for chunk_rows in (5, 8, 1000):
        assert rows(history.purchase_history(frame, chunk_rows=chunk_rows), *COLUMNS) == expected


def test_customers_without_many_orders_are_exchanged_once_and_not_joined(spark):
    lines = [("V", i, i % 5, DAY + timedelta(hours=i), 1, f"{i:03d}") for i in range(100)]
    result = history.purchase_history(orders(spark, *lines))
    result.collect()
    final = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final
    assert final.count("hashpartitioning(vendor_code") == 1


def test_counting_deals_the_tables_of_the_orders_once(spark, sf_dir):
    """One deal of the joined tables for the orders and a narrow one that all counts share."""
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in plain}
    try:
        for key, value in plain.items():
            spark.conf.set(key, value)
        h = history.purchase_history(load_testdata(spark, sf_dir).cohort_orders)
        text = h._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    dealt = [row for row in text.splitlines() if "Exchange hashpartitioning(l_partkey" in row]
    assert sum("ReusedExchange" not in row for row in dealt) == 2


def test_order_lines_are_exchanged_once(spark):
    """Both the windows inside chunks and the carried rows read one exchange of the orders."""
    lines = [("V", i, i % 5, DAY + timedelta(hours=i), 1, f"{i:03d}") for i in range(100)]
    result = history.purchase_history(orders(spark, *lines))
    result.collect()
    final = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    assert final.count("REPARTITION_BY_COL") - final.count("ReusedExchange") <= 1


def cohort(spark, *lines, **options):
    return cohorts.cohort_table(history.purchase_history(orders(spark, *lines)), **options)


def test_cohort_counts_customers_and_filters_repeats(spark):
    lines = [
        line(1, DAY), line(2, DAY, customer=2), line(3, DAY + timedelta(1)),  # next day
        line(4, DAY + timedelta(45)),  # 6 March: 44 days, day numbers 6 - 21
    ]
    kept = cohort(spark, *lines)
    assert rows(kept, "gap_bucket", "customers") == [("new to brand", 2)]
    kept = cohort(spark, *lines, repeat_filter="elapsed_days")
    assert rows(kept, "gap_bucket", "customers") == [("2 mo", 1), ("new to brand", 2)]


def test_cohort_of_odd_rows(spark):
    """Rows that come twice, missing customers and times: any history, not only a sorted one."""
    later = DAY + timedelta(100)
    h = spark.createDataFrame(
        [("V", 1, 1, DAY, None, None), ("V", 1, 1, DAY, None, None), ("V", 1, 2, DAY, None, None),
         ("V", 1, None, DAY, None, None), ("V", 2, None, DAY, None, None),
         ("V", 3, 1, None, None, 7), ("V", 3, 1, None, None, 7), ("V", 3, 1, None, DAY, 7),
         (None, 4, 1, later, DAY, None), (None, 4, 1, later, DAY, None)],
        "vendor_code string, item_id int, customer_id int, order_ts timestamp_ntz, "
        "last_order_ts timestamp_ntz, last_item_id int")
    got = cohorts.cohort_table(h)
    assert got.columns == ["vendor_code", "item_id", "order_ts", "last_item_id", "last_order_ts",
                           "gap_bucket", "customers"]
    assert rows(got, "item_id", "gap_bucket", "customers") == [
        (1, "new to brand", 2), (2, "new to brand", 0), (3, "new to brand", 1), (4, "> 3 mo", 1)]


def test_cohort_is_exchanged_without_bucket_and_customers(spark):
    lines = [line(i, DAY + timedelta(days=i), customer=i % 3, item=i % 4) for i in range(40)]
    result = cohort(spark, *lines)
    result.collect()
    final = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [row for row in final.splitlines() if "hashpartitioning(vendor_code" in row]
    assert len(dealt) == 2
    assert not any("gap_bucket" in row for row in dealt)
    assert sum("customer_id" in row.split("hashpartitioning")[1] for row in dealt) == 1


def sample_cohort(spark):
    return spark.createDataFrame(
        [("V", 1, DAY, "new to brand", 97), ("V", 1, DAY + timedelta(40), "2 mo", 1),
         ("V", 2, DAY + timedelta(20), "1 mo", 2), ("V", 2, DAY + timedelta(50), "1 mo", 3),
         ("W", 1, DAY, "new to brand", 5), ("W", 1, DAY, "> 3 mo", 5)],
        "vendor_code string, item_id int, order_ts timestamp_ntz, gap_bucket string, "
        "customers long")


def test_demo_aggregations(spark):
    c = sample_cohort(spark)
    assert rows(cohorts.first_time_by_item(c, "V"), "item_id", "customers") == [(1, 97)]
    assert cohorts.first_time_by_item(c).first().customers == 97
    mix = cohorts.retention_mix(c, 1).collect()
    assert [(r.gap_bucket, r.customers, r.seq) for r in mix] == [
        ("new to brand", 102, 0), ("2 mo", 1, 2), ("> 3 mo", 5, 4)]
    top = cohorts.return_purchases(c, "V").first()
    assert (top.item_id, top.gap_bucket, top.customers) == (2, "1 mo", 5)
    over_time = cohorts.returns_over_time(c)
    assert rows(over_time, "order_year_month", "customers") == [("2001/2", 2), ("2001/3", 3)]


def test_share_labels_hide_small_slices(spark):
    share = cohorts.purchase_type_share(sample_cohort(spark), "V")
    assert rows(share, "gap_bucket", "label") == [
        ("1 mo", "1 mo"), ("2 mo", ""), ("new to brand", "new to brand")]
    assert abs(sum(r.pct for r in share.collect()) - 100) < 1e-9


def test_time_to_return(spark):
    lines = [
        line(1, DAY), line(2, DAY), line(3, DAY + timedelta(10)), line(4, DAY + timedelta(10)),
        line(5, DAY + timedelta(90)), line(6, DAY, customer=2),
        line(7, DAY + timedelta(20), customer=2), line(8, DAY, customer=3),
    ]
    row = cohorts.time_to_return(history.purchase_history(orders(spark, *lines))).first()
    assert (row.returning_customers, row.mean_days, row.p50_days, row.max_days) == (2, 15, 15, 20)


def test_buckets_cover_every_order(spark):
    lines = [line(i, DAY + timedelta(days=i * i)) for i in range(20)]
    h = cohorts.with_gap_bucket(history.purchase_history(orders(spark, *lines)))
    assert h.filter(~h.gap_bucket.isin(*bucket_labels())).count() == 0
