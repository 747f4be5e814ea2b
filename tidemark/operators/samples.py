"""Sampling and cleaning of raw order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 1_000_000
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm", "dd MMM yyyy")
ID_COLUMNS = ("customer_id", "vendor_id")


# Hash digits by which rows are counted: each has DIGIT characters, 65536 values.
DIGIT, LEVELS = 4, 2


def _prefix(level: int) -> Column:
    return F.substring("drawn", 1, DIGIT * level)


def _levels(rows: DataFrame, n: int, levels: int) -> list[DataFrame]:
    """For each level (prefix, copies, below) of the hash prefixes that begin before the n-th row.

    The first level counts all rows by their first digit. Only one prefix can reach past the n-th
    row; the next level counts the rows of that one by one digit more, and so on. A level
    has at most 65536 rows, however many rows are sampled from.
    """
    found, split = [], None
    for level in range(1, levels + 1):
        part, base = rows, F.lit(0)
        if split is not None:
            part = rows.join(F.broadcast(split), _prefix(level - 1) == F.col("of"), "left_semi")
        before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        slots = part.groupBy(_prefix(level).alias("prefix")).agg(F.count("*").alias("copies"))
        if split is not None:
            start = split.select(F.col("of").alias("above"), F.col("below").alias("base"))
            slots = slots.join(
                F.broadcast(start), F.substring("prefix", 1, DIGIT * (level - 1)) == F.col("above"))
            base = F.col("base")
        slots = slots.withColumn(
            "below", base + F.coalesce(F.sum("copies").over(before), F.lit(0))
        ).filter(F.col("below") < n).select("prefix", "copies", "below")
        found.append(slots)
        split = slots.filter(F.col("below") + F.col("copies") > n).select(
            F.col("prefix").alias("of"), "below")
    return found


def sample_orders(
    orders: DataFrame, n: int = SAMPLE_ROWS, seed: int = 0, key: str = "line_id",
    levels: int = LEVELS,
) -> DataFrame:
    """Exactly `n` random rows (all if there are fewer), the same ones on every run.

    Rows are ordered by a hash of seed and key. Counts per hash prefix find the prefix in which the
    n-th row lies, digit by digit: rows of lower prefixes are taken as they are. Only the rows of the
    last split prefix are sorted, one in 2**32 at two levels, with equal rows folded into a count.
    """
    columns = orders.columns
    drawn = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key)))
    rows = orders.withColumn("drawn", drawn)
    found = _levels(rows, n, levels)
    marked, whole = rows, F.lit(False)
    for level, slots in enumerate(found, 1):
        below = slots.filter(F.col("below") + F.col("copies") <= n)
        taken = F.broadcast(below.select(F.col("prefix").alias(f"whole_{level}")))
        marked = marked.join(taken, _prefix(level) == F.col(f"whole_{level}"), "left")
        whole = whole | F.col(f"whole_{level}").isNotNull()
    split = found[-1].filter(F.col("below") + F.col("copies") > n).select(
        F.col("prefix").alias("of"), "below")
    earlier = Window.orderBy("drawn", *columns).rowsBetween(Window.unboundedPreceding, -1)
    rest = (
        rows.join(F.broadcast(split), _prefix(levels) == F.col("of"))
        .groupBy("below", "drawn", *columns).agg(F.count("*").alias("copies"))
        .withColumn("before", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
        .withColumn("take", F.least("copies", F.lit(n) - F.col("below") - F.col("before")))
        .filter(F.col("take") > 0)
        .select(*columns, F.explode(F.sequence(F.lit(1), F.col("take"))))
    )
    return marked.filter(whole).select(*columns).unionByName(rest.select(*columns))


def parse_timestamp(text: Column, formats=TIMESTAMP_FORMATS) -> Column:
    """First format that fits; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def clean_id(text: Column) -> Column:
    """An id printed as a whole number ("17.0" is "17"), halves to the even one ("2.5" is "2").

    NULL if it is not a finite number of at most 28 digits. Decimals keep long ids exact.
    """
    return F.bround(text.try_cast("decimal(38,10)"), 0).cast("decimal(28,0)").cast("string")


def clean_orders(
    orders: DataFrame, ids=ID_COLUMNS, ts: str = "order_ts", formats=TIMESTAMP_FORMATS
) -> DataFrame:
    """Typed order time and whole-number ids from text columns."""
    return orders.withColumns({
        ts: parse_timestamp(F.col(ts), formats).cast("timestamp_ntz"),
        **{c: clean_id(F.col(c)) for c in ids},
    })
