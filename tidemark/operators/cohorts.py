"""Cohorts by time since the last purchase.

Customers are counted per order time and then summed, so the totals below count
customer purchases: a customer who buys in two months counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gaps import (
    BUCKET_EDGES, NEW_BUCKET, bucket_labels, elapsed_days, gap_bucket, repeat_purchase,
)

BUCKET_ORDER = ("vendor_code", "item_id", "gap_bucket")


def with_gap_bucket(history: DataFrame, edges=BUCKET_EDGES) -> DataFrame:
    return history.withColumn(
        "gap_bucket", gap_bucket(F.col("order_ts"), F.col("last_order_ts"), edges)
    )


def cohort_table(
    history: DataFrame,
    repeat_filter: str = "day_of_month",
    edges=BUCKET_EDGES,
    entity: str = "vendor_code",
) -> DataFrame:
    """Distinct customers by item, order time, last purchase and bucket.

    Keeps first purchases and the repeats that pass `repeat_filter` (see
    `repeat_purchase`). Sort with `orderBy(*BUCKET_ORDER)` to show it.
    """
    ts, last = F.col("order_ts"), F.col("last_order_ts")
    kept = history.filter(last.isNull() | repeat_purchase(ts, last, repeat_filter))
    keys = (entity, "item_id", "order_ts", "last_item_id", "last_order_ts")
    counted = kept.groupBy(*keys).agg(F.countDistinct("customer_id").alias("customers"))
    # The bucket follows from the two times, so it need not be a key of the grouping.
    return with_gap_bucket(counted, edges).select(*keys, "gap_bucket", "customers")


def _of(cohort: DataFrame, column: str, value) -> DataFrame:
    return cohort if value is None else cohort.filter(F.col(column) == value)


def _sum_customers(cohort: DataFrame, *keys) -> DataFrame:
    return cohort.groupBy(*keys).agg(F.sum("customers").alias("customers"))


def first_time_by_item(cohort: DataFrame, vendor: str | None = None) -> DataFrame:
    """First-time purchases by item, largest first (all vendors if none is named)."""
    new = _of(cohort, "vendor_code", vendor).filter(F.col("gap_bucket") == NEW_BUCKET)
    return _sum_customers(new, "vendor_code", "item_id").orderBy(F.desc("customers"))


def retention_mix(cohort: DataFrame, item=None, edges=BUCKET_EDGES) -> DataFrame:
    """Customers of an item by bucket; `seq` puts the buckets in order of time."""
    seq = F
    for number, label in enumerate(bucket_labels(edges)):
        seq = seq.when(F.col("gap_bucket") == label, number)
    mix = _sum_customers(_of(cohort, "item_id", item), "item_id", "gap_bucket")
    return mix.withColumn("seq", seq).orderBy("item_id", "seq")


def purchase_type_share(
    cohort: DataFrame, vendor: str | None = None, min_label_pct: float = 2
) -> DataFrame:
    """Percentage of each bucket in a vendor's customers.

    `label` is empty for slices that show as less than `min_label_pct` percent.
    """
    totals = _sum_customers(_of(cohort, "vendor_code", vendor), "vendor_code", "gap_bucket")
    whole = F.sum("customers").over(Window.partitionBy("vendor_code"))
    shown = F.round("pct", 1) >= min_label_pct
    return totals.withColumn("pct", F.col("customers") * 100 / whole).withColumn(
        "label", F.when(shown, F.col("gap_bucket")).otherwise("")
    )


def return_purchases(cohort: DataFrame, vendor: str | None = None) -> DataFrame:
    """Return purchases by item and bucket, largest first."""
    returns = _of(cohort, "vendor_code", vendor).filter(F.col("gap_bucket") != NEW_BUCKET)
    return _sum_customers(returns, "vendor_code", "item_id", "gap_bucket").orderBy(
        F.desc("customers")
    )


def returns_over_time(
    cohort: DataFrame, vendor: str | None = None, bucket: str = "1 mo"
) -> DataFrame:
    """Purchases of one bucket by year and month, largest first."""
    rows = _of(cohort, "vendor_code", vendor).filter(F.col("gap_bucket") == bucket)
    by_month = rows.groupBy(
        F.year("order_ts").alias("order_year"),
        F.month("order_ts").alias("order_month"),
        "vendor_code",
        "gap_bucket",
    ).agg(F.sum("customers").alias("customers"))
    return by_month.withColumn(
        "order_year_month", F.concat_ws("/", "order_year", "order_month")
    ).orderBy(F.desc("customers"))


def time_to_return(history: DataFrame, entity: str = "vendor_code") -> DataFrame:
    """Days from the first to the second purchase time: quartiles over the customers."""
    ts, last = F.col("order_ts"), F.col("last_order_ts")
    second = history.filter((F.col("purchase_rank") == 2) & (last < ts)).select(
        entity, elapsed_days(ts, last).alias("days")
    )
    return second.groupBy(entity).agg(
        F.count("*").alias("returning_customers"),
        F.avg("days").alias("mean_days"),
        *[F.percentile("days", p).alias(f"p{round(p * 100)}_days") for p in (0.25, 0.5, 0.75)],
        F.max("days").alias("max_days"),
    )
