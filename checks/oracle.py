"""DuckDB twins of the registered queries, written from the definitions.

Named steps are CTEs; `sql(select)` puts the steps a select needs in front of it.
Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import re
from datetime import timedelta
from typing import NamedTuple

from tidemark.sources.testdata import CALENDAR, RUN_DATE

RUN = f"DATE '{RUN_DATE}'"
FIRST_DAY = f"DATE '{RUN_DATE - timedelta(days=730)}'"
COMPANY = "C9"
COMPANY_CATEGORIES = (1, 2, 4, 5)


def _list(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def _rows(rows) -> str:
    return ",\n".join(f"({_list(r)})" for r in rows)


def _names(d: dict, column: str) -> str:
    whens = " ".join(f"WHEN {_list([k])} THEN {_list([v])}" for k, v in d.items())
    return f"CASE {column} {whens} END"


# What the reports are defined by, written out here and not taken from the library.
CATEGORY_NAMES = {1: "Economy", 2: "Large", 3: "Medium", 4: "Promo", 5: "Small"}
CATEGORY_CODES = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
CATEGORIES = "1, 2, 3, 4, 5"
APPROVAL_STATUSES = ("Approved", "Scheduled")
PROMOTION_TYPES = ("Best Deal", "Deal of the Day", "Lightning Deal", "Event Deal")
GATE_EARLY_DAY = 25
PRIORITIES = {
    "PRIME DAY": 1, "BSS": 1, "PBDD": 1, "T5/11/12": 1, "BLACK FRIDAY": 2, "CYBER MONDAY": 3,
    "BOXING WEEK": 4, "NYNY": 5,
}
# label, month of the gate (0: none), patterns; in the order in which they are tried
RULES = (
    ("BSS", 0, "%BSS%", "%BIG SPRING SALE%"),
    ("PRIME DAY", 7, "%PRIME%DAY%", "%PD%", "%PEBD%"),
    ("PBDD", 0, "%PBDD%"),
    ("BLACK FRIDAY", 0, "%BF%", "%BLACK%FRIDAY%"),
    ("CYBER MONDAY", 0, "%CYBER%MONDAY%", "%CM%"),
    ("BOXING WEEK", 0, "%BOXING WEEK%", "%BOXING DAY%"),
    ("T5/11/12", 0, "%T5%", "%T11%", "%T12%"),
    ("BACK TO SCHOOL", 0, "%BACK%TO%SCHOOL%"),
    ("BACK TO UNIVERSITY", 0, "%BACK%TO%UNIVERSITY%"),
    ("NYNY", 0, "%NYNY%"),
    ("MOTHERS DAY", 5, "%MOTHER%DAY%"),
    ("FATHERS DAY", 0, "%FATHER%DAY%"),
    ("VALENTINES DAY", 0, "%VALENTINE%DAY%"),
    ("GIFT MANIA", 0, "%GIFT%MANIA%"),
    ("HALLOWEEN", 0, "%HALLOWEEN%"),
    ("HOLIDAY", 0, "%HOLIDAY%"),
    ("LUNAR NEW YEAR", 0, "%LUNAR%NEW%YEAR%"),
    ("DAILY ESSENTIALS", 0, "%DAILY%ESSENTIALS%"),
    ("BEAUTY HAUL", 0, "%BEAUTY%HAUL%"),
    ("PET DAY", 5, "%PET%DAY%", "%PET%MONTH%"),
    ("HEALTH & WELLNESS MONTH", 0, "%HEALTH%WELLNESS%"),
    ("GAMING MONTH", 0, "%GAMING%MONTH%"),
    ("BABY SAVINGS", 0, "%BABY%SAVINGS%"),
    ("BEAUTY WEEK", 0, "%BEAUTY%WEEK%"),
    ("DIWALI", 0, "%DIWALI%"),
    ("MOVEMBER", 0, "%MOVEMBER%"),
    ("FLASH SALE", 0, "%FLASH SALE%"),
)
RULE_ROWS = [
    (rank, label, pattern, gate)
    for rank, (label, gate, *patterns) in enumerate(RULES) for pattern in patterns
]
METRICS = ("shipped_units", "ops", "customers", "new_customers", "subscribers")


class Level(NamedTuple):
    """Keys that match years, columns of the deal groups, the key a row must have, fill with 0."""

    keys: tuple[str, ...]
    columns: tuple[str, ...]
    required: str | None
    zero_last_year: bool


LEVELS = {
    "item": Level(
        ("item_id",),
        ("item_id", "item_name", "category_code", "category_name", "brand_code", "brand_name",
         "vendor_code", "company_code", "company_name"), None, False),
    "brand": Level(
        ("brand_code",),
        ("brand_code", "brand_name", "vendor_code", "company_code", "company_name",
         "category_code", "category_name"), "brand_code", True),
    "company": Level(
        ("company_code", "category_code"),
        ("company_code", "company_name", "category_code", "category_name"), "company_code", True),
    "category": Level(
        ("category_code",), ("category_code", "category_name"), "category_code", True),
    "event": Level((), (), None, False),
}
REPORT_KEYS = {
    "item": (
        "item_id", "item_name", "category_name", "vendor_code", "company_name", "company_code",
        "brand_code", "brand_name", "event_name", "event_year", "event_month",
        "event_duration_days"),
    "brand": (
        "brand_code", "brand_name", "vendor_code", "company_code", "company_name",
        "category_code", "category_name", "event_name", "event_year", "event_month",
        "promo_start_date", "promo_end_date", "event_duration_days"),
    "company": (
        "company_code", "company_name", "category_code", "category_name", "event_name",
        "event_year", "event_month", "promo_start_date", "promo_end_date", "event_duration_days"),
    "category": (
        "category_code", "category_name", "event_name", "event_year", "event_month",
        "event_duration_days"),
    "event": (
        "event_name", "event_year", "event_month", "promo_start_date", "promo_end_date",
        "event_duration_days"),
}
GROWTH_KEYS = (
    "item_id", "item_name", "category_name", "vendor_code", "company_name", "company_code",
    "brand_code", "brand_name", "event_name", "promo_start_date", "promo_end_date",
    "event_month", "event_year", "event_duration_days",
)
V1_METRICS = (
    "shipped_units", "ops", "ads_amt", "subscription_amt",
    "total_customers_item", "new_customers_item", "return_customers_item",
    "total_customers_brand", "new_customers_brand", "return_customers_brand", "subscribers",
)
V1_DEAL = tuple(f"daily_deal_{m}" for m in V1_METRICS)
V1_PRE_DEAL = tuple(f"daily_pre_deal_{m}" for m in V1_METRICS)
GROWTH = {
    "daily_new_customer_growth_pct_item": "new_customers_item",
    "daily_return_customer_growth_pct_item": "return_customers_item",
    "daily_new_customer_growth_pct_brand": "new_customers_brand",
    "daily_return_customer_growth_pct_brand": "return_customers_brand",
    "daily_subscribers_growth_pct": "subscribers",
}

STEPS: dict[str, str] = {}

# ---- input tables -------------------------------------------------------------------

STEPS["order_lines"] = """
SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id,
  CASE WHEN l_returnflag = 'R' THEN 6 ELSE 1 END AS condition_code
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

STEPS["shipments"] = """
SELECT l_partkey AS item_id,
  CASE WHEN l_partkey % 40 <> 7 THEN CAST(floor(o_custkey / 10) AS BIGINT) END AS customer_id,
  line_id, o_orderdate AS order_ts, CAST(l_quantity AS INT) AS units,
  CASE WHEN l_orderkey % 20 = 0 THEN 1 ELSE 7 END AS marketplace_id,
  CASE WHEN l_orderkey % 8 = 5 THEN 2 ELSE 1 END AS region_id,
  CASE WHEN l_suppkey % 10 = 3 THEN 'N' ELSE 'Y' END AS is_retail, condition_code
FROM order_lines"""

STEPS["places"] = """
SELECT * FROM (VALUES (0, 7, 1, 1), (1, 7, 2, 3), (2, 1, 1, 2), (3, 1, 2, 5))
  AS p(place, marketplace_id, region_id, every)"""

STEPS["listings"] = f"""
SELECT p_partkey AS item_id, marketplace_id, region_id, place,
  CASE place WHEN 0 THEN p_name ELSE p_name || ' - place ' || place END AS item_name,
  {_names(CATEGORY_CODES, 'p_type')} AS category_code,
  CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS brand_code,
  CASE WHEN p_partkey % 50 <> 0 THEN 'Name ' || p_brand END AS brand_name
FROM part JOIN places ON p_partkey % every = 0"""

STEPS["items"] = """
SELECT * EXCLUDE (marketplace_id, region_id, place) FROM listings
WHERE marketplace_id = 7 AND region_id = 1"""

STEPS["all_contribution"] = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id,
  l_partkey AS item_id, marketplace_id,
  CAST(round(price * (1 - CAST(l_discount AS DECIMAL(4,2)))
    + CASE marketplace_id WHEN 7 THEN 0 ELSE 1 END, 2) AS DECIMAL(18,2)) AS revenue,
  CAST(round(price * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS ads_amt,
  CAST(CASE WHEN l_linestatus = 'O' THEN round(price * 0.01, 2) ELSE 0 END AS DECIMAL(18,2))
    AS subscription_amt
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(15,2)) AS price FROM lineitem WHERE l_tax > 0)
JOIN (VALUES (7), (1)) AS m(marketplace_id) ON marketplace_id = 7 OR l_orderkey % 20 = 0"""

STEPS["contribution"] = """
SELECT * EXCLUDE (marketplace_id) FROM all_contribution WHERE marketplace_id = 7"""

STEPS["all_vendors"] = """
SELECT item_id, marketplace_id, region_id,
  (item_id + place) % (SELECT count(*) FROM supplier) AS vendor_code FROM listings"""

STEPS["vendors"] = """
SELECT item_id, vendor_code FROM all_vendors WHERE marketplace_id = 7 AND region_id = 1"""

STEPS["companies"] = """
SELECT s_suppkey AS vendor_code,
  CASE WHEN s_suppkey % 10 <> 0 THEN 'C' || s_nationkey END AS company_code,
  CASE WHEN s_suppkey % 10 <> 0 THEN n_name END AS company_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

STEPS["calendar"] = f"""
SELECT number, title, CAST(first AS DATE) AS first, CAST(final AS DATE) AS final, status, kind,
  marketplace
FROM (VALUES {_rows(CALENDAR)}) AS c(number, title, first, final, status, kind, marketplace)"""

STEPS["promotions"] = """
SELECT s_suppkey * 100 + number AS promotion_key, title || ' - ' || s_name AS promo_title,
  first AS promo_start_date, final AS promo_end_date, status, kind, marketplace
FROM supplier CROSS JOIN calendar"""

STEPS["promo_lines"] = """
SELECT l_suppkey * 100 + number AS promotion_key, l_partkey AS item_id, line_id,
  marketplace AS marketplace_id
FROM order_lines JOIN calendar ON o_orderdate BETWEEN first AND final
WHERE l_discount >= 0.05"""

STEPS["snapshots"] = f"""
SELECT l_partkey AS item_id, CAST(o_orderdate AS DATE) AS day,
  CASE WHEN l_suppkey % 8 = 5 THEN 2 ELSE 1 END AS region_id,
  CAST(sum(l_quantity) AS BIGINT) AS active
FROM order_lines
WHERE l_linestatus = 'O' AND l_partkey IN (SELECT item_id FROM items
  WHERE category_code IN ({CATEGORIES}))
GROUP BY l_partkey, l_suppkey, o_orderdate"""

STEPS["cohort_orders"] = """
SELECT CASE WHEN p_partkey % 50 <> 0 THEN p_brand ELSE 'NaN' END AS vendor_code,
  l_partkey AS item_id, o_custkey AS customer_id, o_orderdate AS order_ts, condition_code, line_id
FROM order_lines JOIN part ON l_partkey = p_partkey"""

# ---- order base ---------------------------------------------------------------------

ANY_REGION = "marketplace_id = 7 AND units > 0 AND is_retail = 'Y'"
SHIPPED = f"{ANY_REGION} AND region_id = 1"

STEPS["profile"] = f"""
SELECT i.*, {_names(CATEGORY_NAMES, 'category_code')} AS category_name, v.vendor_code,
  c.company_code, c.company_name
FROM items i
LEFT JOIN vendors v ON v.item_id = i.item_id
LEFT JOIN companies c ON c.vendor_code = v.vendor_code
WHERE category_code IN ({CATEGORIES})"""

BASE_COLUMNS = """p.item_id, customer_id, s.line_id, CAST(order_ts AS DATE) AS order_date, units,
  item_name, category_code, category_name, brand_code, brand_name, vendor_code, company_code,
  company_name"""

def base(where: str) -> str:
    return f"""
SELECT DISTINCT {BASE_COLUMNS}, coalesce(revenue, 0) AS revenue
FROM shipments s JOIN profile p ON p.item_id = s.item_id
LEFT JOIN contribution c ON c.line_id = s.line_id AND c.item_id = s.item_id
WHERE condition_code <> 6 AND {where}"""


STEPS["base"] = base(f"{SHIPPED} AND order_ts BETWEEN {FIRST_DAY} AND {RUN}")


def base_of_places(where: str, company: bool = True) -> str:
    """Base orders in which every line meets the item, vendor and amounts of its own place."""
    return f"""
SELECT DISTINCT s.item_id, customer_id, s.line_id, CAST(order_ts AS DATE) AS order_date, units,
  item_name, category_code, {_names(CATEGORY_NAMES, 'category_code')} AS category_name, brand_code,
  brand_name, v.vendor_code, company_code, company_name, coalesce(revenue, 0) AS revenue
FROM shipments s
JOIN listings i ON i.item_id = s.item_id AND i.marketplace_id = s.marketplace_id
  AND i.region_id = s.region_id AND category_code IN ({CATEGORIES})
LEFT JOIN all_vendors v ON v.item_id = s.item_id AND v.marketplace_id = s.marketplace_id
  AND v.region_id = s.region_id
LEFT JOIN companies c ON c.vendor_code = v.vendor_code
LEFT JOIN all_contribution a ON a.line_id = s.line_id AND a.item_id = s.item_id
  AND a.marketplace_id = s.marketplace_id
WHERE units > 0 AND is_retail = 'Y' AND condition_code <> 6
  AND order_ts BETWEEN {FIRST_DAY} AND {RUN} AND {where}"""


STEPS["base_all_regions"] = base_of_places("s.marketplace_id = 7")
STEPS["base_all_places"] = base_of_places("true")
STEPS["base_v2"] = base(
    f"{SHIPPED} AND company_code = '{COMPANY}' AND category_code IN ({_list(COMPANY_CATEGORIES)})"
    f" AND CAST(order_ts AS DATE) BETWEEN {FIRST_DAY} AND {RUN}")

STEPS["base_v1"] = f"""
SELECT p.item_id, customer_id, s.line_id, CAST(order_ts AS DATE) AS order_date, units, item_name,
  category_code, brand_code, brand_name, coalesce(revenue, 0) AS revenue,
  coalesce(ads_amt, 0) AS ads_amt, coalesce(subscription_amt, 0) AS subscription_amt
FROM shipments s JOIN profile p ON p.item_id = s.item_id
LEFT JOIN contribution c ON c.line_id = s.line_id AND c.item_id = s.item_id
WHERE {SHIPPED} AND order_ts BETWEEN {FIRST_DAY} AND {RUN}"""

# v1 takes the amounts of any marketplace
STEPS["base_v1_all_places"] = f"""
SELECT s.item_id, customer_id, s.line_id, CAST(order_ts AS DATE) AS order_date, units, item_name,
  category_code, brand_code, brand_name, coalesce(revenue, 0) AS revenue,
  coalesce(ads_amt, 0) AS ads_amt, coalesce(subscription_amt, 0) AS subscription_amt
FROM shipments s JOIN listings i ON i.item_id = s.item_id
  AND i.marketplace_id = s.marketplace_id AND i.region_id = s.region_id
LEFT JOIN all_contribution c ON c.line_id = s.line_id AND c.item_id = s.item_id
WHERE units > 0 AND is_retail = 'Y' AND category_code IN ({CATEGORIES})
  AND order_ts BETWEEN {FIRST_DAY} AND {RUN}"""

def subscribers(where: str) -> str:
    return f"""
SELECT item_id, day AS metric_date, avg(active) AS daily_subscribers
FROM snapshots WHERE day >= {FIRST_DAY} AND {where} GROUP BY ALL"""


STEPS["subscribers"] = subscribers("region_id = 1")
STEPS["subscribers_any_region"] = subscribers("true")

# ---- events -------------------------------------------------------------------------

STEPS["rules"] = f"""
SELECT * FROM (VALUES {_rows(RULE_ROWS)}) AS r(rank, label, pattern, gate)"""


def labelled(source: str, key: str, start: str, gated: bool) -> str:
    """Rows of a source with the label of their lowest-ranked matching rule."""
    gate = (
        f"AND (gate IN (0, month({start})) OR (gate - 1 = month({start}) "
        f"AND gate > 0 AND day({start}) >= {GATE_EARLY_DAY}))"
        if gated else ""
    )
    return f"""
SELECT t.*, coalesce(m.event_name, 'OTHER') AS event_name
FROM {source} t LEFT JOIN (
  SELECT {key}, arg_min(label, rank) AS event_name
  FROM {source} JOIN rules ON upper(promo_title) LIKE pattern {gate} GROUP BY {key}
) m USING ({key})"""


def eligible(lead: bool, marketplace: str = "marketplace = 7") -> str:
    return f"""
SELECT promotion_key, promo_title, promo_start_date, promo_end_date FROM promotions
WHERE {marketplace} AND status IN ({_list(APPROVAL_STATUSES)})
  AND kind IN ({_list(PROMOTION_TYPES)}) AND NOT contains(upper(promo_title), 'OIH')
  {"" if lead else "AND NOT contains(upper(promo_title), 'LEAD')"}
  AND promo_start_date BETWEEN {FIRST_DAY} AND {RUN}"""


STEPS["eligible"] = eligible(lead=False)
STEPS["eligible_v1"] = eligible(lead=True)
STEPS["labelled_promotions"] = labelled("eligible", "promotion_key", "promo_start_date", True)
STEPS["labelled_v1"] = labelled("eligible_v1", "promotion_key", "promo_start_date", False)

STEPS["raw_events"] = f"""
SELECT DISTINCT l.item_id, line_id, promo_start_date, promo_end_date,
  CAST(year(promo_start_date) AS INT) AS event_year,
  CAST(month(promo_start_date) AS INT) AS event_month, event_name
FROM promo_lines l JOIN labelled_promotions p USING (promotion_key)
JOIN listings i ON i.item_id = l.item_id AND i.marketplace_id = l.marketplace_id
  AND i.region_id = 1 AND category_code IN ({CATEGORIES})"""

PRIORITY = f"coalesce({_names(PRIORITIES, 'event_name')}, 99)"
OVERLAP_ORDER = f"{PRIORITY}, promo_start_date, promo_end_date, event_name"

STEPS["resolved"] = f"""
SELECT * FROM raw_events
QUALIFY row_number() OVER (PARTITION BY item_id, line_id ORDER BY {OVERLAP_ORDER}) = 1"""

STEPS["resolved_month"] = f"""
SELECT * FROM raw_events QUALIFY row_number() OVER (
  PARTITION BY item_id, event_month ORDER BY {OVERLAP_ORDER}, line_id) = 1"""


def standards(source: str) -> str:
    return f"""
SELECT event_name, event_year, event_month, promo_start_date, promo_end_date,
  frequency
FROM (SELECT * EXCLUDE (item_id, line_id), count(*) AS frequency FROM {source} GROUP BY ALL)
QUALIFY frequency >= 3 AND row_number() OVER (PARTITION BY event_name, event_year
  ORDER BY frequency DESC, promo_start_date, promo_end_date, event_month) = 1"""


STEPS["standards"] = standards("resolved")
STEPS["standards_month"] = standards("resolved_month")

STEPS["consolidated"] = """
SELECT item_id, line_id, r.event_name, r.event_year,
  coalesce(s.event_month, r.event_month) AS event_month,
  coalesce(s.promo_start_date, r.promo_start_date) AS promo_start_date,
  coalesce(s.promo_end_date, r.promo_end_date) AS promo_end_date
FROM resolved r LEFT JOIN standards s USING (event_name, event_year)"""

STEPS["consolidated_strict"] = """
SELECT item_id, line_id, s.event_name, r.event_year, s.event_month, s.promo_start_date,
  s.promo_end_date
FROM resolved_month r LEFT JOIN standards_month s
  ON r.event_name = s.event_name AND r.event_year = s.event_year"""

STEPS["deal_lines"] = f"""
SELECT DISTINCT *, promo_start_date AS deal_start_date, promo_end_date AS deal_end_date,
  promo_start_date - 29 AS pre_deal_start_date, promo_start_date - 1 AS pre_deal_end_date,
  CAST(least(promo_end_date, {RUN}) - promo_start_date + 1 AS INT) AS event_duration_days
FROM consolidated"""

STEPS["windows"] = "SELECT DISTINCT * EXCLUDE (line_id) FROM deal_lines"

# ---- period orders and flags --------------------------------------------------------

STEPS["pre_deal_orders"] = """
SELECT b.*, w.* EXCLUDE (item_id), 'PRE_DEAL' AS period_type,
  coalesce(daily_subscribers, 0) AS daily_subscribers
FROM windows w JOIN base b ON b.item_id = w.item_id
  AND order_date BETWEEN pre_deal_start_date AND pre_deal_end_date
LEFT JOIN subscribers s ON s.item_id = b.item_id AND metric_date = order_date"""

STEPS["deal_orders"] = """
SELECT b.*, d.* EXCLUDE (item_id, line_id), 'DEAL' AS period_type,
  coalesce(daily_subscribers, 0) AS daily_subscribers
FROM deal_lines d JOIN base b ON b.item_id = d.item_id AND b.line_id = d.line_id
  AND order_date BETWEEN deal_start_date AND deal_end_date
LEFT JOIN subscribers s ON s.item_id = b.item_id AND metric_date = order_date"""

STEPS["period_orders"] = """
SELECT * FROM pre_deal_orders UNION ALL BY NAME SELECT * FROM deal_orders"""


def first_levels(where: str) -> str:
    return f"""
SELECT DISTINCT customer_id, item_id, brand_code, company_code, category_code,
  min(order_date) OVER (PARTITION BY customer_id, item_id) AS first_item_purchase,
  min(order_date) OVER (PARTITION BY customer_id, brand_code) AS first_brand_purchase,
  min(order_date) OVER (PARTITION BY customer_id, company_code, category_code)
    AS first_company_purchase,
  min(order_date) OVER (PARTITION BY customer_id, category_code) AS first_category_purchase
FROM base WHERE {where}"""


STEPS["first_levels"] = first_levels(f"order_date >= {RUN} - 365")
STEPS["first_levels_all"] = first_levels("true")

FLAG_COLUMNS = ",\n".join(
    f"CAST({name} IS NULL OR {name} BETWEEN period_start AND period_end AS INT) AS is_{name}"
    for name in (
        "first_item_purchase", "first_brand_purchase", "first_company_purchase",
        "first_category_purchase",
    )
)
PERIOD_BOUNDS = """
  CASE period_type WHEN 'DEAL' THEN deal_start_date ELSE pre_deal_start_date END AS period_start,
  CASE period_type WHEN 'DEAL' THEN deal_end_date ELSE pre_deal_end_date END AS period_end"""


def flags(firsts: str, null_safe: bool = False) -> str:
    same = "IS NOT DISTINCT FROM" if null_safe else "="
    match = " AND ".join(
        f"o.{k} {same} f.{k}"
        for k in ("customer_id", "item_id", "brand_code", "company_code", "category_code")
    )
    return f"""
SELECT DISTINCT o.* EXCLUDE (period_start, period_end), {FLAG_COLUMNS}
FROM (SELECT *, {PERIOD_BOUNDS} FROM period_orders) o LEFT JOIN {firsts} f ON {match}"""


STEPS["flags"] = flags("first_levels")
STEPS["flags_whole_history"] = flags("first_levels_all")
STEPS["flags_null_keys"] = flags("first_levels", null_safe=True)

# ---- level metrics ------------------------------------------------------------------

NEW = {
    "item": "is_first_item_purchase = 1",
    "brand": "is_first_brand_purchase = 1",
    "company": "is_first_company_purchase = 1",
    "category": "is_first_category_purchase = 1",
    "event": "is_first_item_purchase + is_first_brand_purchase + is_first_company_purchase"
             " + is_first_category_purchase > 0",
}


def _five(level: str, period: str, prefix: str, days: str, divide: str) -> str:
    inside = f"period_type = '{period}'"
    new = f"{inside} AND {NEW[level]}"
    new_customers = (
        f"count(*) FILTER ({new})" if level == "item"
        else f"count(DISTINCT customer_id) FILTER ({new})"
    )
    return f"""
  CAST(sum(units) FILTER ({inside}) AS BIGINT) {divide} {days} AS {prefix}_shipped_units,
  CAST(sum(revenue) FILTER ({inside}) AS DOUBLE) / {days} AS {prefix}_ops,
  count(DISTINCT customer_id) FILTER ({inside}) {divide} {days} AS {prefix}_customers,
  {new_customers} {divide} {days} AS {prefix}_new_customers,
  avg(daily_subscribers) FILTER ({inside}) AS {prefix}_subscribers"""


def deal_metrics(level: str, divide: str = "/", whole_year: bool = False) -> str:
    spec = LEVELS[level]
    columns, month = (spec.keys, "") if whole_year else (spec.columns, ", event_month")
    keys = "".join(f"{c}, " for c in columns) + "event_name, event_year" + month
    days = (
        "max(event_duration_days)" if level == "item"
        else "CAST(max(promo_end_date) - min(promo_start_date) + 1 AS INT)"
    )
    extra = {
        "item": ", count(DISTINCT item_id) AS deal_unique_item_count",
        "event": """,
  count(DISTINCT item_id) FILTER (period_type = 'DEAL') AS unique_item_count,
  count(DISTINCT brand_code) FILTER (period_type = 'DEAL') AS unique_brand_count,
  count(DISTINCT company_code) FILTER (period_type = 'DEAL') AS unique_company_count""",
    }.get(level, "")
    where = f"WHERE {spec.required} IS NOT NULL" if spec.required else ""
    return f"""
SELECT {keys}, min(promo_start_date) AS promo_start_date, max(promo_end_date) AS promo_end_date,
  {days} AS event_duration_days, {_five(level, 'DEAL', 'daily_deal', days, divide)}{extra}
FROM flags {where} GROUP BY {keys}"""


def pre_deal_metrics(level: str, divide: str = "/") -> str:
    keys = "".join(f"{c}, " for c in LEVELS[level].keys) + "event_name, event_year"
    extra, where = "", "WHERE period_type = 'PRE_DEAL'"
    if level == "event":
        extra = (
            ", count(DISTINCT item_id) FILTER (period_type = 'PRE_DEAL')"
            " AS pre_deal_unique_item_count"
        )
        where = ""
    return f"""
SELECT {keys}, {_five(level, 'PRE_DEAL', 'daily_pre_deal', '29', divide)}{extra}
FROM flags {where} GROUP BY {keys}"""


def _growth(level: str) -> str:
    keys = ", ".join((*LEVELS[level].keys, "event_name", "event_year"))
    deltas = ", ".join(
        f"daily_deal_{m} - daily_pre_deal_{m} AS delta_daily_{m}" for m in METRICS
    )
    return f"SELECT *, {deltas} FROM deal_{level} LEFT JOIN pre_{level} USING ({keys})"


LY_COLUMNS = [f"{p}_{m}" for p in ("daily_deal", "daily_pre_deal") for m in METRICS]
LY_PARTICIPATION = {
    "item": {"deal_unique_item_count": "ly_unique_item_count"},
    "event": {
        c: f"ly_{c}" for c in ("unique_item_count", "unique_brand_count", "unique_company_count")
    },
}


def _final(level: str) -> str:
    spec = LEVELS[level]
    fill = (lambda c: f"coalesce(y.{c}, 0)") if spec.zero_last_year else (lambda c: f"y.{c}")
    columns = [f"{fill(c)} AS ly_{c}" for c in LY_COLUMNS]
    columns += [f"y.{c} AS {a}" for c, a in LY_PARTICIPATION.get(level, {}).items()]
    match = " AND ".join(
        [f"t.{k} = y.{k}" for k in (*spec.keys, "event_name")] + ["t.event_year - 1 = y.event_year"]
    )
    return f"""
SELECT t.*, {', '.join(columns)} FROM growth_{level} t LEFT JOIN year_{level} y ON {match}"""


def _report(level: str) -> str:
    zero = LEVELS[level].zero_last_year
    fill = (lambda c: f"coalesce({c}, 0)") if zero else (lambda c: c)
    text = {"event_year", "event_month"}
    columns = [
        f"CAST({c} AS VARCHAR) AS {c}" if c in text else c for c in REPORT_KEYS[level]
    ]
    for c, a in LY_PARTICIPATION.get(level, {}).items():
        columns += [c, a]
    if level == "event":
        columns.append("pre_deal_unique_item_count")
    deltas = [f"delta_daily_{m}" for m in METRICS]
    metrics = [*LY_COLUMNS, *deltas, *(f"ly_{c}" for c in LY_COLUMNS)]
    columns += [f"{fill(c)} AS {c}" for c in metrics]
    columns += [
        f"{fill(f'ly_daily_deal_{m}')} - {fill(f'ly_daily_pre_deal_{m}')} AS ly_delta_daily_{m}"
        for m in METRICS
    ]
    return f"SELECT {', '.join(columns)} FROM final_{level}"


for _level in LEVELS:
    STEPS[f"deal_{_level}"] = deal_metrics(_level)
    STEPS[f"pre_{_level}"] = pre_deal_metrics(_level)
    STEPS[f"growth_{_level}"] = _growth(_level)
    STEPS[f"deal_year_{_level}"] = deal_metrics(_level, whole_year=True)
    _by = ", ".join((*LEVELS[_level].keys, "event_name", "event_year"))
    STEPS[f"year_{_level}"] = f"SELECT * FROM deal_year_{_level} LEFT JOIN pre_{_level} USING ({_by})"
    STEPS[f"final_{_level}"] = _final(_level)
    STEPS[f"report_{_level}"] = _report(_level)

# ---- v1 -----------------------------------------------------------------------------

STEPS["raw_events_v1"] = """
SELECT DISTINCT line_id, item_id, promotion_key, promo_start_date, promo_end_date, promo_title,
  event_name
FROM promo_lines JOIN labelled_v1 USING (promotion_key)"""

STEPS["merged"] = """
SELECT item_id, line_id, event_name, CAST(year(promo_start_date) AS INT) AS event_year,
  CAST(month(promo_start_date) AS INT) AS event_month,
  min(promo_start_date) AS promo_start_date, max(promo_end_date) AS promo_end_date
FROM raw_events_v1 GROUP BY ALL"""

STEPS["ranges"] = """
SELECT item_id, event_name, event_year, event_month, min(p.promo_start_date) AS promo_start_date,
  max(p.promo_end_date) AS promo_end_date, min(p.promo_start_date) - 91 AS pre_deal_start_date,
  min(p.promo_start_date) - 1 AS pre_deal_end_date
FROM merged p GROUP BY item_id, event_name, event_year, event_month"""

V1_DURATION = f"CAST(least(promo_end_date, {RUN}) - promo_start_date + 1 AS INT)"

STEPS["deal_orders_v1"] = f"""
SELECT b.*, p.* EXCLUDE (item_id, line_id), {V1_DURATION} AS event_duration_days,
  'DEAL' AS period_type, 'Y' AS is_promotion
FROM base_v1 b JOIN merged p ON p.item_id = b.item_id AND p.line_id = b.line_id
  AND order_date BETWEEN promo_start_date AND promo_end_date"""

STEPS["pre_deal_orders_v1"] = """
SELECT DISTINCT b.*, r.* EXCLUDE (item_id, pre_deal_start_date, pre_deal_end_date),
  'PRE_DEAL' AS period_type, 'N' AS is_promotion
FROM base_v1 b JOIN ranges r ON r.item_id = b.item_id
  AND order_date BETWEEN pre_deal_start_date AND pre_deal_end_date"""

STEPS["deal_orders_v2"] = f"""
SELECT b.*, p.* EXCLUDE (item_id, line_id), {V1_DURATION} AS event_duration_days,
  'DEAL' AS period_type, 'Y' AS is_promotion,
  promo_start_date - 29 AS pre_deal_start_date, promo_start_date - 1 AS pre_deal_end_date
FROM base_v2 b JOIN consolidated_strict p ON p.item_id = b.item_id AND p.line_id = b.line_id
  AND order_date BETWEEN promo_start_date AND promo_end_date"""

STEPS["pre_deal_orders_v2"] = """
SELECT DISTINCT b.*, r.* EXCLUDE (i), 'PRE_DEAL' AS period_type, 'N' AS is_promotion
FROM base_v2 b JOIN (
  SELECT item_id AS i, event_name, event_year, event_month,
    min(c.promo_start_date) AS promo_start_date, max(c.promo_end_date) AS promo_end_date
  FROM consolidated_strict c GROUP BY item_id, event_name, event_year, event_month) r
ON i = item_id AND order_date BETWEEN promo_start_date - 91 AND promo_start_date - 1"""

STEPS["first_v1"] = """
SELECT customer_id, brand_code, min(order_date) AS first_purchase_date
FROM (SELECT customer_id, brand_code, order_date FROM deal_orders_v1 UNION ALL
  SELECT customer_id, brand_code, order_date FROM pre_deal_orders_v1)
WHERE brand_code IS NOT NULL GROUP BY ALL"""


def summary(source: str) -> str:
    return f"""
SELECT o.*, CAST(coalesce(order_date = first_purchase_date, false) AS INT)
  AS is_first_brand_purchase
FROM {source} o LEFT JOIN first_v1 f
  ON f.customer_id = o.customer_id AND f.brand_code = o.brand_code"""


STEPS["deal_summary"] = summary("deal_orders_v1")
STEPS["pre_deal_summary"] = summary("pre_deal_orders_v1")

V1_CUSTOMERS = {
    "total_customers": "count(DISTINCT customer_id)",
    "new_customers": "count(DISTINCT customer_id) FILTER (is_first_brand_purchase = 1)",
    "return_customers": "count(DISTINCT customer_id) FILTER (is_first_brand_purchase = 0)",
}
V1_SUMS = {
    "shipped_units": "units", "ops": "revenue", "ads_amt": "ads_amt",
    "subscription_amt": "subscription_amt",
}


def metrics_v1(
    source: str, keys: str, prefix: str, days: str, tail: str, divide: str = "/"
) -> str:
    """`divide`: how whole numbers (units and customers, not amounts) are divided."""
    brand = ", ".join(f"{e} AS {n}" for n, e in V1_CUSTOMERS.items())
    columns = [f"CAST(sum(units) AS BIGINT) {divide} {days} AS {prefix}_shipped_units"]
    columns += [f"CAST(sum({c}) AS DOUBLE) / {days} AS {prefix}_{n}"
                for n, c in V1_SUMS.items() if n != "shipped_units"]
    columns += [f"{e} {divide} {days} AS {prefix}_{n}_item" for n, e in V1_CUSTOMERS.items()]
    columns += [f"any_value(r.{n}) {divide} {days} AS {prefix}_{n}_brand" for n in V1_CUSTOMERS]
    return f"""
SELECT {keys}, {', '.join(columns)}
FROM {source} s LEFT JOIN (
  SELECT brand_code AS b, event_name AS e, promo_start_date AS d, {brand} FROM {source}
  GROUP BY ALL) r ON r.b = s.brand_code AND r.e = s.event_name AND r.d = s.promo_start_date
{tail}"""


for _name, _divide in (("v1", "/"), ("v1_trunc", "//")):
    STEPS[f"deal_{_name}_items"] = metrics_v1(
        "deal_summary",
        "item_id, item_name, category_code, brand_code, brand_name, event_name, promo_start_date,"
        " promo_end_date, event_duration_days, CAST(month(promo_start_date) AS INT) AS event_month,"
        " CAST(year(promo_start_date) AS INT) AS event_year",
        "daily_deal", "event_duration_days",
        "GROUP BY item_id, item_name, category_code, brand_code, brand_name, event_name,"
        " promo_start_date, promo_end_date, event_duration_days", _divide,
    )
    STEPS[f"deal_{_name}"] = f"""
SELECT d.*, vendor_code FROM deal_{_name}_items d LEFT JOIN vendors v ON v.item_id = d.item_id"""
    STEPS[f"pre_{_name}"] = metrics_v1(
        "pre_deal_summary", "item_id, item_name, brand_code, event_name, promo_start_date",
        "daily_pre_deal", "91", "GROUP BY ALL", _divide,
    )

STEPS["subscribers_v1"] = """
SELECT s.item_id, promo_start_date, event_name,
  avg(active) FILTER (day BETWEEN promo_start_date AND promo_end_date) AS avg_deal_subscribers,
  avg(active) FILTER (day BETWEEN promo_start_date - 91 AND promo_start_date - 1)
    AS avg_pre_deal_subscribers
FROM snapshots s JOIN merged p ON p.item_id = s.item_id
GROUP BY s.item_id, promo_start_date, event_name"""


def _ratio(name: str, metric: str) -> str:
    base = f"daily_pre_deal_{metric}"
    divisor = f"CASE WHEN coalesce({base}, 0) = 0 THEN 1e-9::DOUBLE ELSE {base} END"
    ratio = f"CAST(daily_deal_{metric} / {divisor} - 1 AS DECIMAL(38,9))"
    return f"CAST(round({ratio}, 2) AS DOUBLE) AS {name}"


for _name in ("v1", "v1_trunc"):
    STEPS[f"growth_{_name}_inputs"] = f"""
SELECT d.*, {_names(CATEGORY_NAMES, 'category_code')} AS category_name, company_code,
  company_name, p.* EXCLUDE (item_id, item_name, brand_code, event_name, promo_start_date),
  avg_deal_subscribers AS daily_deal_subscribers,
  avg_pre_deal_subscribers AS daily_pre_deal_subscribers
FROM deal_{_name} d
LEFT JOIN pre_{_name} p ON p.item_id = d.item_id AND p.event_name = d.event_name
  AND p.promo_start_date = d.promo_start_date
LEFT JOIN subscribers_v1 s ON s.item_id = d.item_id AND s.event_name = d.event_name
  AND s.promo_start_date = d.promo_start_date
LEFT JOIN companies c ON c.vendor_code = d.vendor_code"""
    STEPS[f"growth_{_name}"] = f"""
SELECT {', '.join((*GROWTH_KEYS, *V1_DEAL, *V1_PRE_DEAL))},
  {', '.join(_ratio(n, m) for n, m in GROWTH.items())}
FROM growth_{_name}_inputs"""

STEPS["windows_v1"] = f"""
SELECT DISTINCT item_id, event_name, event_year, promo_start_date, promo_end_date,
  event_duration_days AS days, {', '.join((*V1_DEAL, *V1_PRE_DEAL))} FROM growth_v1"""
STEPS["years_v1"] = f"""
SELECT item_id, event_name, event_year,
  {', '.join(f'sum({c} * days) / sum(days) FILTER ({c} IS NOT NULL) AS {c}' for c in V1_DEAL)},
  {', '.join(f'avg({c}) AS {c}' for c in V1_PRE_DEAL)}
FROM windows_v1 GROUP BY ALL"""
STEPS["report_v1"] = f"""
SELECT t.*, {', '.join(f'y.{c} AS ly_{c}' for c in (*V1_DEAL, *V1_PRE_DEAL))}
FROM growth_v1 t LEFT JOIN years_v1 y ON y.item_id = t.item_id AND y.event_name = t.event_name
  AND y.event_year = t.event_year - 1"""

# ---- cohorts ------------------------------------------------------------------------

HISTORY = """
SELECT vendor_code, item_id, customer_id, order_ts,
  CAST(dense_rank() OVER (c ORDER BY order_ts) AS INT) AS purchase_rank,
  lag(order_ts) OVER (c ORDER BY order_ts, line_id) AS last_order_ts,
  lag(item_id) OVER (c ORDER BY order_ts, line_id) AS last_item_id
FROM {} WHERE vendor_code <> 'NaN' AND condition_code <> 6
WINDOW c AS (PARTITION BY vendor_code, customer_id)"""
STEPS["history"] = HISTORY.format("cohort_orders")
STEPS["clicked_orders"] = """
SELECT 'shop' AS vendor_code, event_id AS item_id, user_id AS customer_id, ts AS order_ts,
  1 AS condition_code, lpad(CAST(event_id AS VARCHAR), 20, '0') AS line_id
FROM events WHERE event_type = 'purchase'"""
STEPS["clicked_history"] = HISTORY.format("clicked_orders")

GAP_DAYS = "date_sub('day', last_order_ts, order_ts)"

BUCKETS = f"""
SELECT *, CASE WHEN last_order_ts IS NULL THEN 'new to brand' WHEN {GAP_DAYS} > 90 THEN '> 3 mo'
  WHEN {GAP_DAYS} > 60 THEN '3 mo' WHEN {GAP_DAYS} > 30 THEN '2 mo' ELSE '1 mo' END AS gap_bucket
FROM """
STEPS["buckets"] = BUCKETS + "history"
STEPS["clicked_buckets"] = BUCKETS + "clicked_history"


def cohort(repeat: str) -> str:
    return f"""
SELECT vendor_code, item_id, order_ts, last_item_id, last_order_ts, gap_bucket,
  count(DISTINCT customer_id) AS customers
FROM buckets WHERE last_order_ts IS NULL OR {repeat} GROUP BY ALL"""


STEPS["cohort"] = cohort("day(order_ts) - day(last_order_ts) > 1")
STEPS["cohort_elapsed"] = cohort(f"{GAP_DAYS} > 1")

# ---- shares of new customers --------------------------------------------------------


def share(level: str, extra: str = "") -> str:
    spec = LEVELS[level]
    keys = "".join(f"{k}, " for k in spec.keys) + extra + "event_name, event_year, period_type"
    where = f"WHERE {spec.required} IS NOT NULL" if spec.required else ""
    return f"""
SELECT {keys}, count(DISTINCT customer_id) AS customers,
  count(DISTINCT customer_id) FILTER ({NEW[level]}) AS new_customers,
  CAST(sum(units) AS BIGINT) AS shipped_units, CAST(sum(revenue) AS DOUBLE) AS ops,
  new_customers / nullif(customers, 0) AS new_share
FROM flags {where} GROUP BY {keys}"""


for _level in LEVELS:
    STEPS[f"share_{_level}"] = share(_level)
STEPS["share_item_category"] = share("item", "category_code, ")
STEPS["share_brand_category"] = share("brand", "category_code, ")

# ---- assembling ---------------------------------------------------------------------

_WORD = re.compile(r"\b[a-z_0-9]+\b")


def _needed(text: str, found: list[str], steps: dict[str, str]) -> list[str]:
    for name in dict.fromkeys(_WORD.findall(text)):
        if name in steps and name not in found:
            _needed(steps[name], found, steps)
            if name not in found:
                found.append(name)
    return found


def sql(select: str, instead: dict[str, str] | None = None) -> str:
    """`instead`: other definitions of some steps, for a query in another scope."""
    steps = STEPS | (instead or {})
    needed = _needed(select, [], steps)
    if not needed:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({steps[n]})" for n in needed) + "\n" + select


def rounded(source: str, columns, money=(), instead: dict[str, str] | None = None) -> str:
    """All of a step, doubles rounded to six places and money as doubles."""
    replaced = [f"round({c}, 6) AS {c}" for c in columns]
    replaced += [f"CAST({c} AS DOUBLE) AS {c}" for c in money]
    return sql(f"SELECT * REPLACE ({', '.join(replaced)}) FROM {source}", instead)



def company_chain(where: str) -> dict[str, str]:
    """Definitions of the v2 chain, in which the v3 flags read v2 orders."""
    days = """*, promo_start_date AS deal_start_date, promo_end_date AS deal_end_date"""
    base_orders = base(
        f"{SHIPPED} AND {where} AND CAST(order_ts AS DATE) BETWEEN {FIRST_DAY} AND {RUN}")
    return {
        "base": base_orders,
        "base_v2": base_orders,
        "period_orders": f"""
SELECT p.*, coalesce(daily_subscribers, 0) AS daily_subscribers
FROM (SELECT {days} FROM deal_orders_v2 UNION ALL BY NAME
  SELECT {days}, promo_start_date - 91 AS pre_deal_start_date,
    promo_start_date - 1 AS pre_deal_end_date FROM pre_deal_orders_v2) p
LEFT JOIN subscribers_any_region s ON s.item_id = p.item_id AND metric_date = order_date""",
    }


# Definitions of a scope without marketplace and region.
EVERYWHERE = {
    "base": STEPS["base_all_places"],
    "eligible": eligible(lead=False, marketplace="true"),
    "subscribers": STEPS["subscribers_any_region"],
}
