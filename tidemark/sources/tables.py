"""The nine input tables and their columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Column names and types as the operators need them. Keys may be strings or numbers:
# nothing depends on their type as long as both sides of a join agree.
SCHEMAS = {
    "shipments": (
        "item_id string, customer_id long, line_id string, order_ts timestamp, units int, "
        "marketplace_id int, region_id int, is_retail string, condition_code int"
    ),
    "items": (
        "item_id string, marketplace_id int, region_id int, item_name string, "
        "category_code int, brand_code string, brand_name string"
    ),
    "contribution": (
        "line_id string, item_id string, marketplace_id int, revenue decimal(18,2), "
        "ads_amt decimal(18,2), subscription_amt decimal(18,2)"
    ),
    "item_vendor": "item_id string, marketplace_id int, region_id int, vendor_code string",
    "vendor_company": "vendor_code string, company_code string, company_name string",
    "promo_lines": (
        "promotion_key long, item_id string, line_id string, marketplace_id int, region_id int"
    ),
    "promotions": (
        "promotion_key long, start_ts timestamp, end_ts timestamp, promo_title string, "
        "marketplace_id int, approval_status string, promotion_type string"
    ),
    "subscriptions_daily": (
        "item_id string, snapshot_date timestamp, active_subscribers long, "
        "marketplace_id int, region_id int, category_code int"
    ),
    "cohort_orders": (
        "vendor_code string, item_id string, customer_id long, order_ts timestamp, "
        "condition_code int, line_id string"
    ),
}


@dataclass(frozen=True)
class Sources:
    """The input tables as lazy DataFrames; see SCHEMAS for their columns."""

    shipments: DataFrame
    items: DataFrame
    contribution: DataFrame
    item_vendor: DataFrame
    vendor_company: DataFrame
    promo_lines: DataFrame
    promotions: DataFrame
    subscriptions_daily: DataFrame
    cohort_orders: DataFrame
