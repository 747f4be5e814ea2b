"""Approximate customer counts: their error, and what stays exact."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import metrics, sketches
from tidemark.operators.firsts import FLAGS
from tidemark.operators.metrics import LEVELS

LINES = 120_000


@pytest.fixture(scope="module")
def flags(spark):
    """Lines of 40 items and two events; some customers, brands and companies are unknown."""
    n = F.col("id")
    flagged = {flag: (F.pmod(F.xxhash64("id", F.lit(flag)), F.lit(5)) == 0).cast("int")
               for flag in FLAGS}
    day = F.lit("2001-07-10").cast("date")
    return spark.range(LINES).select(
        (n % 40).alias("item_id"), F.concat(F.lit("item "), n % 40).alias("item_name"),
        (n % 5).cast("int").alias("category_code"), F.lit("c").alias("category_name"),
        F.when(n % 40 != 3, (n % 8).cast("string")).alias("brand_code"), F.lit("b").alias("brand_name"),
        F.lit("V").alias("vendor_code"),
        F.when(n % 40 != 4, F.lit("C")).alias("company_code"), F.lit("Co").alias("company_name"),
        F.when(n % 13 == 0, "BSS").otherwise("PRIME DAY").alias("event_name"),
        F.lit(2001).alias("event_year"), F.lit(7).alias("event_month"),
        F.when(n % 3 == 0, "PRE_DEAL").otherwise("DEAL").alias("period_type"),
        F.when(n % 40 != 7, F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("customer_id"),
        (n % 4).cast("int").alias("units"), (n % 100).cast("decimal(18,2)").alias("revenue"),
        (n % 10).cast("double").alias("daily_subscribers"), day.alias("promo_start_date"),
        F.date_add(day, 9).alias("promo_end_date"), F.lit(10).alias("event_duration_days"),
        *[c.alias(f) for f, c in flagged.items()],
    )


@pytest.mark.parametrize("level", LEVELS)
def test_error_beyond_exact_sets(flags, level):
    """2**9 slots: standard error 4.6 %; every estimate within four of them, all else equal."""
    summary = sketches.event_summary(flags, lg_k=9)
    pairs = (
        (metrics.deal_metrics(flags, LEVELS[level]),
         sketches.approximate_deal_metrics(summary, LEVELS[level]), "daily_deal"),
        (metrics.pre_deal_metrics(flags, LEVELS[level]),
         sketches.approximate_pre_deal_metrics(summary, LEVELS[level]), "daily_pre_deal"),
    )
    for exact, estimated, prefix in pairs:
        assert sorted(exact.columns) == sorted(estimated.columns)
        customers = [f"{prefix}_customers", f"{prefix}_new_customers"]
        rest = [c for c in exact.columns if c not in customers and not c.endswith("subscribers")]
        assert rows(exact, *rest) == rows(estimated, *rest)
        keys = [c for c in rest if not c.startswith(prefix)]
        found = {tuple(r[k] for k in keys): r for r in estimated.collect()}
        for row in exact.collect():
            other = found[tuple(row[k] for k in keys)]
            for c in customers:
                assert abs(other[c] - row[c]) <= 4 * 1.04 / 2 ** 4.5 * row[c] + 1e-9
            assert other[f"{prefix}_subscribers"] == pytest.approx(row[f"{prefix}_subscribers"])


def test_default_size_is_exact_for_small_groups_and_close_for_large_ones(flags):
    summary = sketches.event_summary(flags)
    exact = metrics.deal_metrics(flags, LEVELS["event"]).collect()
    found = {r.event_name: r for r in sketches.approximate_deal_metrics(
        summary, LEVELS["event"]).collect()}
    for row in exact:
        n = row.daily_deal_customers * row.event_duration_days
        assert found[row.event_name].daily_deal_customers == pytest.approx(
            row.daily_deal_customers, rel=0.0001 if n < 1500 else 0.03)
    few = flags.filter("item_id = 5 AND revenue < 20")
    assert rows(metrics.deal_metrics(few, LEVELS["brand"]), "brand_code", "daily_deal_customers") == rows(
        sketches.approximate_deal_metrics(sketches.event_summary(few), LEVELS["brand"]),
        "brand_code", "daily_deal_customers")


def test_summaries_of_parts_merge(flags):
    """A summary of each half of the lines gives the estimates of one summary of all."""
    halves = sketches.event_summary(flags.filter("revenue < 50")).unionByName(
        sketches.event_summary(flags.filter("revenue >= 50"), lg_k=14))
    columns = ("category_code", "event_name", "daily_deal_customers", "daily_deal_shipped_units")
    of_halves = sketches.approximate_deal_metrics(halves, LEVELS["category"])
    of_all = sketches.approximate_deal_metrics(sketches.event_summary(flags), LEVELS["category"])
    for a, b in zip(rows(of_halves, *columns), rows(of_all, *columns)):
        assert a[:2] == b[:2]
        assert a[2] == pytest.approx(b[2], rel=0.02) and a[3] == b[3]


def test_levels_merge_the_summary_without_customers(flags):
    text = sketches.approximate_deal_metrics(
        sketches.event_summary(flags), LEVELS["brand"])._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and not any("customer_id" in line for line in shuffled)


def test_no_rows(spark, flags):
    none = flags.limit(0)
    for level in LEVELS.values():
        assert sketches.approximate_deal_metrics(sketches.event_summary(none), level).count() == 0
