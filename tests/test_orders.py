from datetime import date, datetime
from decimal import Decimal
from types import SimpleNamespace

import pytest

from tests.conftest import rows
from tidemark.operators import orders
from tidemark.scope import Scope
from tidemark.sources import SCHEMAS

RUN = date(2001, 8, 1)
SCOPE = Scope(categories={1: "One", 2: "Two"})


def ship(line, ts=datetime(2001, 7, 1, 10), item="i", units=1, marketplace=7, region=1,
         retail="Y", condition=1, customer=1):
    return (item, customer, line, ts, units, marketplace, region, retail, condition)


@pytest.fixture()
def sources(spark):
    def table(name, *lines):
        return spark.createDataFrame(list(lines), SCHEMAS[name])

    return SimpleNamespace(
        shipments=table(
            "shipments", ship("ok"), ship("ok"), ship("no amount"), ship("units", units=0),
            ship("market", marketplace=1), ship("region", region=2), ship("retail", retail="N"),
            ship("cancelled", condition=6), ship("unknown", condition=None),
            ship("midnight", datetime(2001, 8, 1)), ship("today", datetime(2001, 8, 1, 9)),
            ship("first", datetime(1999, 8, 2)), ship("old", datetime(1999, 8, 1, 23)),
            ship("out of scope", item="k"), ship("no vendor", item="j"),
        ),
        items=table(
            "items", ("i", 7, 1, "Item", 1, "B", "Brand"), ("j", 7, 1, "Jar", 2, None, None),
            ("k", 7, 1, "Kit", 3, "B", "Brand"), ("i", 1, 1, "Elsewhere", 1, "B", "Brand"),
            ("i", 7, 2, "Item", 1, "B", "Brand")),
        contribution=table(
            "contribution", ("ok", "i", 7, Decimal("9.50"), Decimal("1.00"), Decimal("0.50")),
            ("ok", "i", 1, Decimal("7.00"), Decimal("0.00"), Decimal("0.00")),
            ("first", "i", 7, None, None, None)),
        item_vendor=table("item_vendor", ("i", 7, 1, "V")),
        vendor_company=table("vendor_company", ("V", "C", "Company")),
    )


def test_base_orders(sources):
    got = orders.base_orders(sources, SCOPE, RUN)
    assert rows(got, "line_id", "revenue") == [
        ("first", 0), ("midnight", 0), ("no amount", 0), ("no vendor", 0), ("ok", Decimal("9.50"))]
    row = got.filter("line_id = 'ok'").first()
    assert (row.category_name, row.company_code, row.order_date) == (
        "One", "C", date(2001, 7, 1))
    assert got.filter("line_id = 'no vendor'").first().company_code is None


def test_base_orders_v1_keeps_duplicates_and_conditions(sources):
    got = orders.base_orders_amounts(sources, SCOPE, RUN)
    lines = [r[0] for r in rows(got, "line_id")]
    assert lines == ["cancelled", "first", "midnight", "no amount", "no vendor", "ok", "ok", "ok",
                     "ok", "unknown"]  # two equal lines x amounts of two marketplaces


def test_base_orders_v2_includes_the_run_date_of_one_company(sources):
    scope = Scope(categories={1: "One", 2: "Two"}, history_days=30)
    got = orders.base_orders_company(sources, scope, RUN, "C")
    assert [r[0] for r in rows(got, "line_id")] == ["midnight", "today"]
    wider = Scope(categories={1: "One"}, history_days=31)
    got = orders.base_orders_company(sources, wider, RUN, "C")
    assert [r[0] for r in rows(got, "line_id")] == ["midnight", "no amount", "ok", "today"]


def test_daily_subscribers(spark):
    table = spark.createDataFrame(
        [("i", datetime(2001, 7, 1), 2, 7, 1, 1), ("i", datetime(2001, 7, 1, 5), 5, 7, 1, 1),
         ("i", datetime(2001, 7, 1), 90, 7, 2, 1), ("i", datetime(2001, 7, 1), 90, 1, 1, 1),
         ("i", datetime(1999, 8, 1), 9, 7, 1, 1), ("i", datetime(2001, 7, 2), 9, 7, 1, 3)],
        SCHEMAS["subscriptions_daily"])
    got = orders.daily_subscribers(table, SCOPE, RUN)
    assert rows(got) == [("i", date(2001, 7, 1), 3.5)]
    anywhere = orders.daily_subscribers(table, SCOPE, RUN, any_region=True)
    assert rows(anywhere) == [("i", date(2001, 7, 1), 97 / 3)]


def test_lines_meet_the_items_of_their_own_place(spark, sources):
    """An item of two regions and marketplaces has a name, a vendor and amounts in each."""
    def table(name, *lines):
        return spark.createDataFrame(list(lines), SCHEMAS[name])

    sources.shipments = table(
        "shipments", ship("a"), ship("b", region=2), ship("c", marketplace=1), ship("c"),
        ship("d", marketplace=1, region=2), ship("same", region=1), ship("same", region=2),
        ship("j", item="j"), ship("j", item="j", region=2))
    sources.items = table(
        "items", ("i", 7, 1, "Item", 1, "B", "Brand"), ("i", 7, 2, "Two", 1, "B", "Brand"),
        ("i", 1, 1, "Elsewhere", 1, "B", "Brand"), ("j", 7, 1, "Jar", 2, None, None),
        ("j", 7, 2, "Jar", 2, None, None))
    sources.item_vendor = table("item_vendor", ("i", 7, 1, "V"), ("i", 7, 2, "W"), ("i", 1, 1, "W"))
    sources.contribution = table(
        "contribution", ("c", "i", 7, Decimal(5), None, None), ("c", "i", 1, Decimal(6), None, None))

    def base(**open_places):
        scope = Scope(categories=SCOPE.categories, **open_places)
        return rows(orders.base_orders(sources, scope, RUN), "line_id", "item_name", "vendor_code",
                    "revenue")

    here = [("a", "Item", "V", 0), ("c", "Item", "V", 5), ("j", "Jar", None, 0),
            ("same", "Item", "V", 0)]
    regions = sorted([*here, ("b", "Two", "W", 0), ("same", "Two", "W", 0)], key=str)
    assert base() == here
    assert base(region_id=None) == regions
    assert base(region_id=None, marketplace_id=None) == sorted(
        [*regions, ("c", "Elsewhere", "W", 6)], key=str)
    assert base(marketplace_id=None) == sorted([*here, ("c", "Elsewhere", "W", 6)], key=str)
    everywhere = Scope(categories=SCOPE.categories, region_id=None, marketplace_id=None)
    v1 = orders.base_orders_amounts(sources, everywhere, RUN)
    assert rows(v1.filter("line_id = 'c'"), "item_name", "revenue") == [
        ("Elsewhere", 5), ("Elsewhere", 6), ("Item", 5), ("Item", 6)]
    v2 = orders.base_orders_company(sources, everywhere, RUN, "C")
    assert [r[0] for r in rows(v2, "line_id")] == ["a", "c", "same"]


def test_no_region_is_any_region(spark, sources):
    anywhere = Scope(categories=SCOPE.categories, region_id=None)
    got = [r[0] for r in rows(orders.base_orders(sources, anywhere, RUN), "line_id")]
    assert got == ["first", "midnight", "no amount", "no vendor", "ok", "region"]
    table = spark.createDataFrame(
        [("i", datetime(2001, 7, 1), 2, 7, 1, 1), ("i", datetime(2001, 7, 1), 4, 7, 2, 1)],
        SCHEMAS["subscriptions_daily"])
    assert rows(orders.daily_subscribers(table, anywhere, RUN)) == [("i", date(2001, 7, 1), 3.0)]
    nowhere = Scope(categories=SCOPE.categories, region_id=None, marketplace_id=None)
    assert "market" in [r[0] for r in rows(orders.shipped_lines(sources, nowhere, RUN), "line_id")]
