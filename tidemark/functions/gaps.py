"""Purchase gaps: whole elapsed days since the last purchase, in buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket edges in days and the labels of first purchases and unknown gaps.
BUCKET_EDGES = (30, 60, 90)
NEW_BUCKET = "new to brand"
UNKNOWN_BUCKET = "/"  # the gap cannot be told


def bucket_labels(edges=BUCKET_EDGES) -> list[str]:
    """All labels in reading order: first purchases, 1 mo, 2 mo, ..., longer."""
    return [NEW_BUCKET, *(f"{i} mo" for i in range(1, len(edges) + 1)), f"> {len(edges)} mo"]


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour days between two timestamps (30 d 23 h is 30)."""
    return F.extract(F.lit("DAY"), later - earlier)


def gap_bucket(order_ts: Column, last_ts: Column, edges=BUCKET_EDGES) -> Column:
    labels = bucket_labels(edges)
    days = elapsed_days(order_ts, last_ts)
    bucket = F.when(last_ts.isNull(), labels[0])
    for edge, label in zip(edges, labels[1:]):
        bucket = bucket.when(days <= edge, label)
    return bucket.when(days > edges[-1], labels[-1]).otherwise(UNKNOWN_BUCKET)


def repeat_purchase(order_ts: Column, last_ts: Column, rule: str = "day_of_month") -> Column:
    """True for a purchase that is not a same-day or next-day repeat.

    "day_of_month" subtracts calendar day numbers, so 31 July to 1 August (-30) and
    20 January to 5 March (-15) fail too; "elapsed_days" uses the real gap.
    """
    if rule == "day_of_month":
        return F.dayofmonth(order_ts) - F.dayofmonth(last_ts) > 1
    if rule == "elapsed_days":
        return elapsed_days(order_ts, last_ts) > 1
    raise ValueError(f"unknown repeat rule: {rule}")
