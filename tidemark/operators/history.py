"""Purchase history: each order with the customer's order before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefilter import drop_marked, keep_marked, mark_frequent

MISSING_VENDOR = "NaN"  # fixed value: how text sources print a missing vendor
EXCLUDED_CONDITIONS = (6,)
# A customer with more orders is not sorted as a whole.
WHOLE_ROWS = 1 << 14
# Slots of the filter that tells such customers: at most 65,536 rows of two numbers, 1 MB.
MARKED_SLOTS = 1 << 22
# About so many orders are worked on together, in up to SIDE * SIDE ranges of one customer and hour.
CHUNK_ROWS = 1 << 20
SIDE = 64
# Orders that are drawn for each range, to cut the ranges to about equal sizes.
DRAWN = 8
_SLOTS = 1 << 30


def purchase_history(
    orders: DataFrame,
    entity: str = "vendor_code",
    excluded_conditions=EXCLUDED_CONDITIONS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rank of each order of a customer with a vendor, and the order before it.

    Adds `purchase_rank` (dense, by time), `last_order_ts` and `last_item_id`. Orders
    at the same time are taken by line id, then item.

    Customers of up to `WHOLE_ROWS` orders are sorted whole, so their orders are exchanged once and
    read once. The others, told by a filter of bounded size, are worked through in chunks.
    """
    kept = orders.filter(
        F.col(entity).isNotNull()
        & (F.col(entity) != MISSING_VENDOR)
        & ~F.col("condition_code").isin(*excluded_conditions)
    ).select(entity, "item_id", "customer_id", "order_ts", "line_id")
    customer = [entity, "customer_id"]
    marks = mark_frequent(kept, customer, min(chunk_rows, WHOLE_ROWS), MARKED_SLOTS)
    # Without any such customer the marks are empty, and the chunks are dropped at run time.
    many = keep_marked(kept, customer, marks.filter("mask <> 0"), MARKED_SLOTS)
    return _in_chunks(many, entity, chunk_rows).unionByName(
        _whole(drop_marked(kept, customer, marks, MARKED_SLOTS), customer))


def _whole(rows: DataFrame, customer: list[str]) -> DataFrame:
    """The history of customers that are sorted as a whole."""
    by_line = Window.partitionBy(*customer).orderBy("order_ts", "line_id", "item_id")
    by_time = Window.partitionBy(*customer).orderBy("order_ts")
    return rows.withColumns({
        "last_order_ts": F.lag("order_ts").over(by_line),
        "last_item_id": F.lag("item_id").over(by_line),
    }).withColumn("purchase_rank", F.dense_rank().over(by_time)).drop("line_id")


def _in_chunks(orders: DataFrame, entity: str, chunk_rows: int) -> DataFrame:
    """The history of customers with many orders, in chunks that follow each other in time.

    A chunk is an hour, and where an hour has more than `chunk_rows` orders, ranges of (time, line
    id, item) of about that many, whatever the ids look like; only orders that are equal in all
    three stay together. What a chunk needs from those before it is one small row per chunk:
    their last order and how many order times they have. So no task holds all orders of a
    customer, and the orders are exchanged once for both.
    """
    # Structs are never NULL and equal if all their fields are, NULLs included. Vendor and customer
    # are in the chunk only, so both readers of the exchange need the same columns.
    rows = orders.select("item_id", "order_ts", "line_id", F.struct(
        F.struct(entity, "customer_id").alias("customer"),
        F.date_trunc("hour", "order_ts").alias("hour"),
    ).alias("block"))
    ranges = _ranges(rows, chunk_rows).withColumnRenamed("block", "of_block")
    rows = rows.join(ranges, F.col("block") == F.col("of_block"), "left").select(
        "item_id", "order_ts", "line_id",
        F.struct("block.customer", "block.hour", _range_of("cuts").alias("range")).alias("chunk"),
    ).repartition("chunk")
    by_line = Window.partitionBy("chunk").orderBy("order_ts", "line_id", "item_id")
    # The rank comes second: its order is a prefix of the first, so one sort serves both.
    inside = rows.withColumns({
        "before_ts": F.lag("order_ts").over(by_line),
        "before_item": F.lag("item_id").over(by_line),
        "position": F.row_number().over(by_line),
    }).withColumn("rank", F.dense_rank().over(Window.partitionBy("chunk").orderBy("order_ts")))
    starts = F.col("position") == 1
    return inside.join(_carried(rows), "chunk").select(
        f"chunk.customer.{entity}", "item_id", "chunk.customer.customer_id", "order_ts",
        F.when(starts, F.col("carried.time.ts")).otherwise(F.col("before_ts"))
        .alias("last_order_ts"),
        F.when(starts, F.col("carried.item_id")).otherwise(F.col("before_item"))
        .alias("last_item_id"),
        (F.col("rank") + F.col("ranked")).cast("int").alias("purchase_rank"),
    )


def _place() -> Column:
    """Where an order stands within its customer's; NULLs come first, as in a window's order."""
    return F.struct("order_ts", "line_id", "item_id")


def _ranges(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """(block, cuts) of the hours of a customer that have more than `chunk_rows` orders.

    The cuts are where the ranges after the first begin, sorted, in rows of SIDE. They come from
    orders drawn by a hash at a rate that gives DRAWN for each range, so they are the same in every
    evaluation. Customers are counted first: only orders of those with many are counted by place.
    The count needs no more columns than the one before it, so no table is dealt again for it.
    """
    customer = ["block.customer"]
    crowds = mark_frequent(rows, customer, chunk_rows, MARKED_SLOTS).filter("mask <> 0")
    many = keep_marked(rows, customer, crowds, MARKED_SLOTS)
    # a place that repeats is drawn so much the more surely
    places = many.groupBy("block", _place().alias("place")).agg(F.count(F.lit(1)).alias("copies"))
    pieces = F.least(F.lit(SIDE * SIDE), F.ceil(F.col("n") / chunk_rows))
    blocks = places.groupBy("block").agg(F.sum("copies").alias("n")).filter(
        F.col("n") > chunk_rows).select(F.col("block").alias("of_block"), "n", pieces.alias("pieces"))
    slot = F.pmod(F.xxhash64("place"), F.lit(_SLOTS))
    drawn = places.join(blocks, F.col("block") == F.col("of_block")).filter(
        slot < F.col("copies") * F.col("pieces") * (DRAWN * _SLOTS) / F.col("n"))
    sorted_places = drawn.groupBy("block").agg(
        F.first("pieces").alias("pieces"), F.sort_array(F.collect_list("place")).alias("places"))
    cut = F.transform(
        F.sequence(F.lit(1), F.col("pieces") - 1),
        lambda i: F.get("places", F.floor(i * F.size("places") / F.col("pieces")).cast("int")))
    return sorted_places.filter("pieces > 1").select(
        "block", F.array_distinct(cut).alias("cut")).select(
        "block", F.transform(
            F.sequence(F.lit(0), F.floor((F.size("cut") - 1) / SIDE)),
            lambda i: F.slice("cut", (i * SIDE + 1).cast("int"), SIDE)).alias("cuts"))


def _range_of(cuts: str) -> Column:
    """The number of cuts up to an order's place: first which row of cuts, then which of the row."""
    row = F.size(F.filter(cuts, lambda r: F.get(r, 0) <= _place()))
    within = F.size(F.filter(F.get(cuts, row - 1), lambda c: c <= _place()))
    return F.when(F.col(cuts).isNotNull() & (row > 0), (row - 1) * SIDE + within).otherwise(0)


def _carried(rows: DataFrame) -> DataFrame:
    """For each chunk the last order before it and the number of order times before its own.

    Ranges of an hour can share an order time, which counts once.
    """
    time = F.struct(F.col("order_ts").isNotNull().alias("known"), F.col("order_ts").alias("ts"))
    chunks = rows.groupBy("chunk", "order_ts").agg(
        F.max(F.struct("line_id", "item_id")).alias("last")
    ).groupBy("chunk").agg(
        F.max(F.struct(time.alias("time"), "last.line_id", "last.item_id")).alias("last"),
        F.min(time).alias("first_time"),
        F.count(F.lit(1)).alias("times"),
    ).withColumn("customer", F.col("chunk.customer"))
    before = Window.partitionBy("customer").orderBy("chunk")
    same = F.coalesce((F.col("first_time") == F.lag("last.time").over(before)).cast("int"), F.lit(0))
    return chunks.withColumns({"same": same, "carried": F.lag("last").over(before)}).select(
        "chunk", "carried",
        (F.coalesce(
            F.sum(F.col("times") - F.col("same")).over(
                before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ) - F.col("same")).alias("ranked"),
    )
