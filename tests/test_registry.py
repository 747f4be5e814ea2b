"""Registered queries against their DuckDB twins at the smallest scale.

CHECK_ALL=1 runs all of them; otherwise one or two per operator family.
"""

import os

import pytest

import __spark_entry__ as entry_points
from checks.compare import difference, duck
from checks.registry import ORACLE, QUERIES

HEADLINE = (
    "base_orders", "base_orders_amounts", "daily_subscribers", "classify_event",
    "eligible_promotions", "resolve_overlaps_month", "consolidated_promos_strict",
    "period_orders", "new_customer_flags", "deal_metrics_item_trunc", "report_item",
    "report_brand", "report_company", "report_category", "report_event", "yoy_delta_brand",
    "report_item_v1", "cohort_table", "time_to_return", "peer_comparison", "ntb_share_lift",
    "sample_orders", "clean_orders", "orders_tsv", "gap_bucket_clock_times", "deal_orders_v2",
)
NAMES = tuple(QUERIES) if os.environ.get("CHECK_ALL") else HEADLINE


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, con, sf_dir, name):
    text, _ = difference(spark, con, sf_dir, name)
    assert text == ""


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE) <= set(entry_points.oracle_sql())
