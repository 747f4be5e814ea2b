"""First purchases and new-customer flags."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scope import LOOKBACK_DAYS
from .keys import join_groups
from .periods import DEAL, PRE_DEAL

PURCHASE_KEYS = ("customer_id", "item_id", "brand_code", "company_code", "category_code")
FIRST_KEYS = {
    "first_item_purchase": ("customer_id", "item_id"),
    "first_brand_purchase": ("customer_id", "brand_code"),
    "first_company_purchase": ("customer_id", "company_code", "category_code"),
    "first_category_purchase": ("customer_id", "category_code"),
}
FLAGS = {
    "is_first_item_purchase": "first_item_purchase",
    "is_first_brand_purchase": "first_brand_purchase",
    "is_first_company_purchase": "first_company_purchase",
    "is_first_category_purchase": "first_category_purchase",
}


def first_purchases(orders: DataFrame, keys=("customer_id", "brand_code")) -> DataFrame:
    """v1: the first order date per customer and brand; orders without a brand have none."""
    return (
        orders.filter(F.col(keys[-1]).isNotNull())
        .groupBy(*keys)
        .agg(F.min("order_date").alias("first_purchase_date"))
    )


def first_purchase_levels(
    base: DataFrame,
    run_date: date,
    lookback_days: int | None = LOOKBACK_DAYS,
) -> DataFrame:
    """First purchase dates at item, brand, company and category level.

    One row per customer, item, brand, company and category bought in the lookback
    (`None`: the whole history). Orders are reduced to those rows first; each level's minimum
    is a grouped table, combined before its shuffle, that is joined back to them. No task
    needs all rows of a customer, however many there are.
    """
    if lookback_days is not None:
        first = run_date - timedelta(days=lookback_days)
        base = base.filter(F.col("order_date").between(F.lit(first), F.lit(run_date)))
    purchases = base.groupBy(*PURCHASE_KEYS).agg(F.min("order_date").alias("first_date"))
    levels = purchases
    for name, keys in FIRST_KEYS.items():
        first = purchases.groupBy(*keys).agg(F.min("first_date").alias(name))
        levels = join_groups(levels, first, keys)
    return levels.select(*PURCHASE_KEYS, *FIRST_KEYS)


def flag_new_by_period(
    orders: DataFrame, firsts: DataFrame, null_keys_are_new: bool = True
) -> DataFrame:
    """Four 0/1 flags: is the customer new at this level in the row's own period?

    New means that no first purchase is known or that it lies inside the period.
    A row without brand or company finds no first purchase and so counts as new at
    every level; `null_keys_are_new=False` matches missing keys to each other.
    """
    if null_keys_are_new:
        joined = orders.join(firsts, list(PURCHASE_KEYS), "left")
    else:
        joined = join_groups(orders, firsts, PURCHASE_KEYS, "left")
    period = F.col("period_type")
    start = F.when(period == DEAL, F.col("deal_start_date")).when(
        period == PRE_DEAL, F.col("pre_deal_start_date")
    )
    end = F.when(period == DEAL, F.col("deal_end_date")).when(
        period == PRE_DEAL, F.col("pre_deal_end_date")
    )
    flags = {
        flag: F.when(F.col(first).isNull() | F.col(first).between(start, end), 1).otherwise(0)
        for flag, first in FLAGS.items()
    }
    return joined.withColumns(flags).select(*orders.columns, *flags)


def flag_new_by_date(orders: DataFrame, firsts: DataFrame) -> DataFrame:
    """v1: 1 on the customer's first order date of the brand; without a brand 0."""
    joined = orders.join(firsts, ["customer_id", "brand_code"], "left")
    is_first = F.col("order_date") == F.col("first_purchase_date")
    return joined.withColumn(
        "is_first_brand_purchase", F.when(is_first, 1).otherwise(0)
    ).select(*orders.columns, "is_first_brand_purchase")
