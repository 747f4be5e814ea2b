"""The nine input tables derived from the order and part tables of the test data.

Every table grows with the files: each supplier runs the whole promotion calendar,
so promotions grow with suppliers and promotion lines with order lines. Where orders and parts
would be broadcast by the compressed size of their files, the joins are by sort and merge.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scope import Scope

RUN_DATE = date(2001, 8, 1)
SCOPE = Scope(categories={1: "Economy", 2: "Large", 3: "Medium", 4: "Promo", 5: "Small"})
CATEGORY_CODES = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
MARKETPLACE = 7
OTHER_MARKETPLACE = 1
REGION = 1

FILE_SCHEMAS = {
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string"
    ),
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string",
}

# number, title, start, end, status, type, marketplace
CALENDAR = (
    (1, "Big Spring Sale 2000", "2000-03-20", "2000-04-02", "Approved", "Best Deal", 7),
    (2, "big spring sale 2001", "2001-03-19", "2001-04-01", "Scheduled", "Event Deal", 7),
    (3, "Pet Day 2000", "2000-05-01", "2000-05-31", "Approved", "Best Deal", 7),
    (4, "Pet Month 2001", "2001-04-25", "2001-05-24", "Approved", "Best Deal", 7),
    (5, "Prime Day 2000", "2000-07-10", "2000-07-24", "Approved", "Lightning Deal", 7),
    (6, "PD early 2000", "2000-06-26", "2000-07-09", "Approved", "Lightning Deal", 7),
    (7, "Prime Day 2001", "2001-07-10", "2001-08-15", "Approved", "Deal of the Day", 7),
    (8, "Black Friday 1999", "1999-11-19", "1999-11-29", "Approved", "Best Deal", 7),
    (9, "BF week 2000", "2000-11-20", "2000-11-30", "Approved", "Best Deal", 7),
    (10, "Cyber Monday 2000", "2000-11-25", "2000-12-02", "Approved", "Best Deal", 7),
    (11, "Weekly offer A", "2000-07-15", "2000-07-20", "Approved", "Best Deal", 7),
    (12, "Weekly offer B", "2000-09-01", "2000-09-20", "Approved", "Best Deal", 7),
    (13, "Halloween 2000", "2000-10-20", "2000-11-05", "Approved", "Best Deal", 7),
    (14, "Prime big day Oct", "2000-10-08", "2000-10-12", "Approved", "Best Deal", 7),
    (15, "OIH clearance", "2000-02-01", "2000-02-20", "Approved", "Best Deal", 7),
    (16, "Mothers Day lead in", "2000-04-20", "2000-05-10", "Approved", "Best Deal", 7),
    (17, "Diwali 2000", "2000-10-20", "2000-11-10", "Draft", "Best Deal", 7),
    (18, "Flash Sale 2000", "2000-08-01", "2000-08-10", "Approved", "Coupon", 7),
    (19, "Gaming Month", "2000-01-05", "2000-02-04", "Approved", "Best Deal", 1),
    (20, "Prime Day 1999", "1999-07-10", "1999-07-20", "Approved", "Best Deal", 7),
)

# Titles that between them reach every rule; orders take them in turn.
TITLE_SAMPLES = (
    "bss preview", "Big Spring Sale", "Prime Day picks", "PD lightning", "pebd", "PBDD two",
    "BF doorbusters", "Black Friday", "Cyber Monday", "CM extra", "Boxing Week", "boxing day",
    "T5 deals", "t11", "T12 last call", "Back to School", "back to university", "NYNY",
    "Mother's Day", "Fathers Day", "Valentine day", "GiftMania", "Halloween", "Holiday hits",
    "Lunar New Year", "Daily Essentials", "Beauty Haul", "Pet Day", "pet month",
    "Health and Wellness", "Gaming Month", "Baby Savings", "Beauty Week", "Diwali", "Movember",
    "Flash Sale", "Price update", "Weekly offer",
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _line_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _money(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(18,2)")


def _condition() -> Column:
    return F.when(F.col("l_returnflag") == "R", 6).otherwise(1)


def _category() -> Column:
    code = F
    for name, number in CATEGORY_CODES.items():
        code = code.when(F.col("p_type") == name, number)
    return code


def _calendar() -> str:
    """The calendar as a SQL array of structs."""
    rows = (
        f"named_struct('number', {number}L, 'title', '{title}', "
        f"'start_ts', timestamp_ntz '{start}', 'end_ts', timestamp_ntz '{end}', "
        f"'approval_status', '{status}', 'promotion_type', '{kind}', "
        f"'marketplace_id', {marketplace})"
        for number, title, start, end, status, kind, marketplace in CALENDAR
    )
    return f"array({', '.join(rows)})"


def _promotion_key(owner: str) -> Column:
    return (F.col(owner) * 100 + F.col("number")).alias("promotion_key")


# Where else an item is listed, under another name and by another vendor: marketplace, region, and
# every how manyth item.
OTHER_LISTINGS = (
    (MARKETPLACE, REGION + 1, 3), (OTHER_MARKETPLACE, REGION, 2), (OTHER_MARKETPLACE, REGION + 1, 5),
)


def _listed(parts: DataFrame) -> DataFrame:
    """Every part in its places: `place` counts them, 0 is the first."""
    places = [(MARKETPLACE, REGION, 1), *OTHER_LISTINGS]
    listings = F.array(*[
        F.struct(F.lit(place).alias("place"), F.lit(marketplace).alias("marketplace_id"),
                 F.lit(region).alias("region_id"), F.lit(every).alias("every"))
        for place, (marketplace, region, every) in enumerate(places)
    ])
    return parts.select("*", F.inline(listings)).filter(F.col("p_partkey") % F.col("every") == 0)


def _region(number: str) -> Column:
    """One row in eight is of a second region."""
    return F.when(F.col(number) % 8 == 5, REGION + 1).otherwise(REGION)


def _customer() -> Column:
    """Every 40th item is sold to unknown customers only."""
    return F.when(F.col("l_partkey") % 40 != 7, F.floor(F.col("o_custkey") / 10))


def _branded() -> Column:
    return F.col("p_partkey") % 50 != 0


class TestdataSources:
    """The tables of `Sources`, each built when it is first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _file(self, name: str) -> DataFrame:
        return _read(self.spark, self.sf_dir, name)

    @cached_property
    def _order_lines(self) -> DataFrame:
        return self._file("lineitem").join(
            self._file("orders"), F.col("l_orderkey") == F.col("o_orderkey")
        )

    @cached_property
    def shipments(self) -> DataFrame:
        return self._order_lines.select(
            F.col("l_partkey").alias("item_id"),
            _customer().alias("customer_id"),
            _line_id().alias("line_id"),
            F.col("o_orderdate").alias("order_ts"),
            F.col("l_quantity").cast("int").alias("units"),
            F.when(F.col("l_orderkey") % 20 == 0, OTHER_MARKETPLACE).otherwise(MARKETPLACE).alias(
                "marketplace_id"
            ),
            _region("l_orderkey").alias("region_id"),
            F.when(F.col("l_suppkey") % 10 == 3, "N").otherwise("Y").alias("is_retail"),
            _condition().alias("condition_code"),
        )

    @cached_property
    def items(self) -> DataFrame:
        elsewhere = F.concat("p_name", F.lit(" - place "), F.col("place").cast("string"))
        return _listed(self._file("part")).select(
            F.col("p_partkey").alias("item_id"),
            "marketplace_id",
            "region_id",
            F.when(F.col("place") == 0, F.col("p_name")).otherwise(elsewhere).alias("item_name"),
            _category().alias("category_code"),
            F.when(_branded(), F.col("p_brand")).alias("brand_code"),
            F.when(_branded(), F.concat(F.lit("Name "), F.col("p_brand"))).alias("brand_name"),
        )

    @cached_property
    def contribution(self) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(15,2)")
        discount, tax = (F.col(c).cast("decimal(4,2)") for c in ("l_discount", "l_tax"))
        subscribed = _money(price * F.lit("0.01").cast("decimal(4,2)"))
        # lines of the other marketplace have amounts in both, one more there
        places = F.when(
            F.col("l_orderkey") % 20 == 0, F.array(F.lit(MARKETPLACE), F.lit(OTHER_MARKETPLACE))
        ).otherwise(F.array(F.lit(MARKETPLACE)))
        here = F.col("marketplace_id") == MARKETPLACE
        lines = self._file("lineitem").filter("l_tax > 0").select(
            "*", F.explode(places).alias("marketplace_id"))
        return lines.select(
            _line_id().alias("line_id"),
            F.col("l_partkey").alias("item_id"),
            "marketplace_id",
            _money(price * (1 - discount) + F.when(here, 0).otherwise(1)).alias("revenue"),
            _money(price * tax).alias("ads_amt"),
            F.when(F.col("l_linestatus") == "O", subscribed)
            .otherwise(F.lit(0).cast("decimal(18,2)"))
            .alias("subscription_amt"),
        )

    @cached_property
    def item_vendor(self) -> DataFrame:
        """Items are spread over all suppliers, so a brand's vendors grow with both."""
        suppliers = self._file("supplier").agg(F.count("*").alias("n")).scalar()
        return _listed(self._file("part")).select(
            F.col("p_partkey").alias("item_id"),
            "marketplace_id",
            "region_id",
            ((F.col("p_partkey") + F.col("place")) % suppliers).alias("vendor_code"),
        )

    @cached_property
    def vendor_company(self) -> DataFrame:
        """Every tenth supplier belongs to no company."""
        owned = F.col("s_suppkey") % 10 != 0
        nation = self._file("nation")
        return (
            self._file("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("vendor_code"),
                F.when(owned, F.concat(F.lit("C"), F.col("s_nationkey"))).alias("company_code"),
                F.when(owned, F.col("n_name")).alias("company_name"),
            )
        )

    @cached_property
    def promotions(self) -> DataFrame:
        return self._file("supplier").selectExpr(
            "s_suppkey", "s_name", f"inline({_calendar()})"
        ).select(
            _promotion_key("s_suppkey"),
            "start_ts",
            "end_ts",
            F.concat_ws(" - ", "title", "s_name").alias("promo_title"),
            "marketplace_id",
            "approval_status",
            "promotion_type",
        )

    @cached_property
    def promo_lines(self) -> DataFrame:
        """Discounted lines of orders placed while a promotion of the supplier ran."""
        first, last = min(c[2] for c in CALENDAR), max(c[3] for c in CALENDAR)
        running = (
            f"inline(filter({_calendar()}, c -> o_orderdate BETWEEN c.start_ts AND c.end_ts))"
        )
        orders = (
            self._file("orders")
            .filter(f"o_orderdate BETWEEN timestamp_ntz '{first}' AND timestamp_ntz '{last}'")
            .selectExpr("o_orderkey", running)
        )
        return (
            self._file("lineitem").filter("l_discount >= 0.05")
            .join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                _promotion_key("l_suppkey"),
                F.col("l_partkey").alias("item_id"),
                _line_id().alias("line_id"),
                "marketplace_id",
                F.lit(REGION).alias("region_id"),
            )
        )

    @cached_property
    def subscriptions_daily(self) -> DataFrame:
        return (
            self._order_lines.filter("l_linestatus = 'O'")
            .groupBy("l_partkey", "l_suppkey", "o_orderdate")
            .agg(F.sum("l_quantity").cast("long").alias("active_subscribers"))
            .join(self._file("part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_partkey").alias("item_id"),
                F.col("o_orderdate").alias("snapshot_date"),
                "active_subscribers",
                F.lit(MARKETPLACE).alias("marketplace_id"),
                _region("l_suppkey").alias("region_id"),
                _category().alias("category_code"),
            )
        )

    @cached_property
    def cohort_orders(self) -> DataFrame:
        part = self._file("part")
        return self._order_lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.when(_branded(), F.col("p_brand")).otherwise("NaN").alias("vendor_code"),
            F.col("l_partkey").alias("item_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_ts"),
            _condition().alias("condition_code"),
            _line_id().alias("line_id"),
        )


def load_testdata(spark: SparkSession, sf_dir: str) -> TestdataSources:
    return TestdataSources(spark, sf_dir)


def clicked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as order lines: order times with hours and fractions of seconds."""
    return _read(spark, sf_dir, "events").filter("event_type = 'purchase'").select(
        F.lit("shop").alias("vendor_code"),
        F.col("event_id").alias("item_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("order_ts"),
        F.lit(1).alias("condition_code"),
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("line_id"),
    )


def titled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One title and start date per order, so that all rules meet all months."""
    quoted = ", ".join(f'"{t}"' for t in TITLE_SAMPLES)
    samples = F.expr(f"array({quoted})")
    position = (F.col("o_orderkey") % len(TITLE_SAMPLES)).cast("int")
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("promotion_key"),
        F.concat_ws(" ", F.get(samples, position), F.col("o_orderpriority")).alias("promo_title"),
        F.to_date("o_orderdate").alias("start_date"),
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as untyped text: ids printed as decimals, dates in several formats."""
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm", "dd MMM yyyy")
    style = F.col("l_linenumber") % (len(formats) + 1)
    text = F
    for number, pattern in enumerate(formats):
        text = text.when(style == number, F.date_format("o_orderdate", pattern))
    lines = _read(spark, sf_dir, "lineitem").join(
        _read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    number = F.col("o_custkey").cast("string")
    odd = F.col("o_custkey") % 12
    return lines.select(
        _line_id().alias("line_id"),
        F.when(odd == 0, F.lit("n/a")).when(odd == 1, F.lit("NaN")).when(odd == 2, F.lit("Infinity"))
        .when(odd == 3, F.concat(F.lit("90071992547409"), F.lpad(number, 8, "0")))
        .when(odd == 4, F.concat(number, F.lit(".5"))).when(odd == 5, F.concat(number, F.lit("e3")))
        .otherwise(F.concat(number, F.lit(".0")))
        .alias("customer_id"),
        F.col("l_suppkey").cast("string").alias("vendor_id"),
        text.otherwise("unknown").alias("order_ts"),
    )
