"""The registered queries: name -> (Spark query, DuckDB twin)."""

from __future__ import annotations

import atexit
from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import classify_event
from tidemark.operators import cohorts, compare, events, history, item_growth, metrics
from tidemark.operators import orders, periods, samples, shares
from tidemark.operators.metrics import LEVELS, METRICS
from tidemark.plans import CompanyPipeline, EventPipeline, ItemGrowthPipeline
from tidemark.session import Staging, configure, shared_folder
from tidemark.sources import read_orders_csv, write_csv
from tidemark.sources.testdata import (
    RUN_DATE, SCOPE, TITLE_SAMPLES, clicked_orders, load_testdata, raw_orders, titled_orders,
)

from . import oracle as o

SAMPLE = 1000
TOP = 20


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and doubles to six places, so that engines compare equal."""
    changed = {}
    for name, kind in df.dtypes:
        if kind == "double":
            changed[name] = F.round(name, 6)
        elif kind.startswith("decimal"):
            changed[name] = F.col(name).cast("double")
    return df.withColumns(changed) if changed else df


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, build: Callable, twin: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return plain(build(spark, sf_dir))

    QUERIES[name] = query
    if twin is not None:
        ORACLE[name] = twin


def _staging(spark) -> Staging:
    """Tables for one query; its result is lazy and reads them, so they go with the process."""
    staging = Staging(spark)
    if staging.path is not None:
        atexit.register(_drop, staging)
    return staging


def _drop(staging: Staging) -> None:
    if staging.spark._jsc.sc().isStopped():
        return  # the session took its folder with it or keeps it for a reason
    staging.close()


def events_pipeline(spark, sf_dir, **options) -> EventPipeline:
    options.setdefault("staging", _staging(spark))
    scope = options.pop("scope", SCOPE)
    return EventPipeline(load_testdata(spark, sf_dir), RUN_DATE, scope, **options)


def from_events(build: Callable[[EventPipeline], DataFrame], **options) -> Callable:
    return lambda spark, sf_dir: build(events_pipeline(spark, sf_dir, **options))


def from_growth(build: Callable[[ItemGrowthPipeline], DataFrame], **options) -> Callable:
    return lambda spark, sf_dir: build(ItemGrowthPipeline(
        load_testdata(spark, sf_dir), RUN_DATE, SCOPE, staging=_staging(spark), **options
    ))


def from_sources(build: Callable) -> Callable:
    return lambda spark, sf_dir: build(load_testdata(spark, sf_dir))


def from_history(build: Callable[[DataFrame], DataFrame]) -> Callable:
    return lambda spark, sf_dir: build(
        history.purchase_history(load_testdata(spark, sf_dir).cohort_orders)
    )


def from_cohort(build: Callable[[DataFrame], DataFrame]) -> Callable:
    return from_history(lambda h: build(cohorts.cohort_table(h)))


# ---- order base ---------------------------------------------------------------------

register(
    "base_orders", from_sources(lambda s: orders.base_orders(s, SCOPE, RUN_DATE)),
    o.rounded("base", (), ("revenue",)),
)
register(
    "base_orders_amounts", from_sources(lambda s: orders.base_orders_amounts(s, SCOPE, RUN_DATE)),
    o.rounded("base_v1", (), ("revenue", "ads_amt", "subscription_amt")),
)
ALL_REGIONS = replace(SCOPE, region_id=None)
register(
    "base_orders_all_regions",
    from_sources(lambda s: orders.base_orders(s, ALL_REGIONS, RUN_DATE)),
    o.rounded("base_all_regions", (), ("revenue",)),
)
EVERYWHERE = replace(ALL_REGIONS, marketplace_id=None)
register(
    "base_orders_all_places",
    from_sources(lambda s: orders.base_orders(s, EVERYWHERE, RUN_DATE)),
    o.rounded("base_all_places", (), ("revenue",)),
)
register(
    "base_orders_amounts_all_places",
    from_sources(lambda s: orders.base_orders_amounts(s, EVERYWHERE, RUN_DATE)),
    o.rounded("base_v1_all_places", (), ("revenue", "ads_amt", "subscription_amt")),
)
SCOPE_COMPANY = replace(
    SCOPE, categories={c: SCOPE.categories[c] for c in o.COMPANY_CATEGORIES}
)


def _base_company(s) -> DataFrame:
    return orders.base_orders_company(s, SCOPE_COMPANY, RUN_DATE, o.COMPANY)


register(
    "base_orders_company",
    from_sources(_base_company), o.rounded("base_v2", (), ("revenue",)),
)
register(
    "daily_subscribers",
    from_sources(lambda s: orders.daily_subscribers(s.subscriptions_daily, SCOPE, RUN_DATE)),
    o.rounded("subscribers", ("daily_subscribers",)),
)
register(
    "daily_subscribers_all_regions",
    from_sources(lambda s: orders.daily_subscribers(s.subscriptions_daily, ALL_REGIONS, RUN_DATE)),
    o.rounded("subscribers_any_region", ("daily_subscribers",)),
)
register(
    "daily_subscribers_v2",
    from_sources(lambda s: orders.daily_subscribers(
        s.subscriptions_daily, SCOPE_COMPANY, RUN_DATE, any_region=True)),
    o.sql(f"""
SELECT item_id, metric_date, round(daily_subscribers, 6) AS daily_subscribers
FROM subscribers_any_region
WHERE item_id IN (SELECT item_id FROM items
  WHERE category_code IN ({o._list(o.COMPANY_CATEGORIES)}))"""),
)

# ---- events -------------------------------------------------------------------------

register(
    "eligible_promotions",
    from_sources(lambda s: events.eligible_promotions(s.promotions, SCOPE, RUN_DATE)),
    o.sql("SELECT * FROM eligible"),
)


register(
    "eligible_promotions_all_marketplaces",
    from_sources(lambda s: events.eligible_promotions(s.promotions, EVERYWHERE, RUN_DATE)),
    o.sql("SELECT * FROM eligible", o.EVERYWHERE),
)


def _titles(gated: bool) -> Callable:
    def build(spark, sf_dir):
        titles = titled_orders(spark, sf_dir)
        start = F.col("start_date") if gated else None
        return titles.withColumn("event_name", classify_event(F.col("promo_title"), start))
    return build


TITLED = f"""
SELECT o_orderkey AS promotion_key, concat_ws(' ', sample, o_orderpriority) AS promo_title,
  CAST(o_orderdate AS DATE) AS start_date
FROM orders JOIN (VALUES {o._rows(
    (i, t.replace("'", "''")) for i, t in enumerate(TITLE_SAMPLES)
)}) AS s(slot, sample) ON slot = o_orderkey % {len(TITLE_SAMPLES)}"""
o.STEPS["titled"] = TITLED
register("classify_event", _titles(True), o.sql(
    o.labelled("titled", "promotion_key", "start_date", True)))
register("classify_event_v1", _titles(False), o.sql(
    o.labelled("titled", "promotion_key", "start_date", False)))

register("promo_events", from_events(lambda p: p.promo_events), o.sql("SELECT * FROM raw_events"))
register("promo_events_all_marketplaces", from_events(lambda p: p.promo_events, scope=EVERYWHERE),
         o.sql("SELECT * FROM raw_events", o.EVERYWHERE))
register("promo_events_v1", from_growth(lambda p: p.promo_events),
         o.sql("SELECT * FROM raw_events_v1"))
register("event_priority", from_events(lambda p: p.promo_events.select(
    "item_id", "line_id", "event_name",
    events.event_priority(F.col("event_name")).alias("priority"))),
    o.sql(f"SELECT item_id, line_id, event_name, {o.PRIORITY} AS priority FROM raw_events"))
register("resolve_overlaps", from_events(lambda p: p.resolved), o.sql("SELECT * FROM resolved"))


def _resolved_month(p: EventPipeline) -> DataFrame:
    return events.resolve_overlaps(p.promo_events, ("item_id", "event_month"))


register("resolve_overlaps_month", from_events(_resolved_month),
         o.sql("SELECT * FROM resolved_month"))
register("standard_event_dates", from_events(lambda p: p.standards),
         o.sql("SELECT * FROM standards"))
register("consolidated_promos", from_events(lambda p: p.consolidated),
         o.sql("SELECT * FROM consolidated"))


def _consolidated_strict(p: EventPipeline) -> DataFrame:
    resolved = _resolved_month(p)
    return events.consolidate_promos(
        resolved, events.standard_event_dates(resolved), fallback=False
    )


register("consolidated_promos_strict", from_events(_consolidated_strict),
         o.sql("SELECT * FROM consolidated_strict"))
register("merge_promo_windows", from_growth(lambda p: p.promos), o.sql("SELECT * FROM merged"))
register("event_windows", from_events(lambda p: p.deal_lines), o.sql("SELECT * FROM deal_lines"))
register(
    "event_windows_weeks_before",
    from_events(lambda p: p.deal_lines, benchmark_days=8, benchmark_gap_days=14),
    o.sql("SELECT * REPLACE (promo_start_date - 21 AS pre_deal_start_date,"
          " promo_start_date - 14 AS pre_deal_end_date) FROM deal_lines"),
)
register("benchmark_ranges", from_growth(lambda p: p.ranges), o.sql("SELECT * FROM ranges"))
register("item_windows", from_events(lambda p: p.windows), o.sql("SELECT * FROM windows"))

# ---- period orders ------------------------------------------------------------------

PERIOD = ("daily_subscribers",)


def _base(p: EventPipeline) -> DataFrame:
    return orders.attach_amounts(p.base_lines, p.src.contribution, SCOPE.marketplace_id)


register(
    "pre_deal_orders",
    from_events(lambda p: periods.pre_deal_orders(p.windows, _base(p), p.subscribers)),
    o.rounded("pre_deal_orders", PERIOD, ("revenue",)),
)
register(
    "deal_orders",
    from_events(lambda p: periods.deal_orders(p.deal_lines, _base(p), p.subscribers)),
    o.rounded("deal_orders", PERIOD, ("revenue",)),
)
register("period_orders", from_events(lambda p: p.period_orders),
         o.rounded("period_orders", PERIOD, ("revenue",)))
AMOUNTS = ("revenue", "ads_amt", "subscription_amt")


def _deal_orders_v2(p: EventPipeline) -> DataFrame:
    return periods.deal_orders_v2(_base_company(p.src), _consolidated_strict(p), RUN_DATE)


def _pre_deal_orders_v2(p: EventPipeline) -> DataFrame:
    ranges = events.benchmark_ranges(_consolidated_strict(p))
    return periods.pre_deal_orders_v1(_base_company(p.src), ranges)


register("deal_orders_v2", from_events(_deal_orders_v2),
         o.rounded("deal_orders_v2", (), ("revenue",)))
register("pre_deal_orders_v2", from_events(_pre_deal_orders_v2),
         o.rounded("pre_deal_orders_v2", (), ("revenue",)))
register("deal_orders_v1", from_growth(lambda p: p.deal_orders),
         o.rounded("deal_orders_v1", (), AMOUNTS))
register("pre_deal_orders_v1", from_growth(lambda p: p.pre_deal_orders),
         o.rounded("pre_deal_orders_v1", (), AMOUNTS))

# ---- first purchases and flags ------------------------------------------------------

register("first_purchase_brand", from_growth(lambda p: p.first_purchases),
         o.sql("SELECT * FROM first_v1"))
register("first_purchase_levels", from_events(lambda p: p.firsts),
         o.sql("SELECT * FROM first_levels"))
register("first_purchase_levels_whole_history",
         from_events(lambda p: p.firsts, lookback_days=None),
         o.sql("SELECT * FROM first_levels_all"))
register("daily_summary_deal", from_growth(lambda p: p.deal_summary),
         o.rounded("deal_summary", (), AMOUNTS))
register("daily_summary_pre_deal", from_growth(lambda p: p.pre_deal_summary),
         o.rounded("pre_deal_summary", (), AMOUNTS))
register("new_customer_flags", from_events(lambda p: p.flags),
         o.rounded("flags", PERIOD, ("revenue",)))
register("new_customer_flags_whole_history", from_events(lambda p: p.flags, lookback_days=None),
         o.rounded("flags_whole_history", PERIOD, ("revenue",)))
register("new_customer_flags_null_keys", from_events(lambda p: p.flags, null_keys_are_new=False),
         o.rounded("flags_null_keys", PERIOD, ("revenue",)))



def from_company(build: Callable[[CompanyPipeline], DataFrame], **options) -> Callable:
    return lambda spark, sf_dir: build(CompanyPipeline(
        load_testdata(spark, sf_dir), RUN_DATE, SCOPE, staging=_staging(spark), **options
    ))


register("company_flags", from_company(lambda p: p.flags, company=o.COMPANY),
         o.rounded("flags", PERIOD, ("revenue",), o.company_chain(f"company_code = '{o.COMPANY}'")))
register("company_flags_all_companies", from_company(lambda p: p.flags),
         o.rounded("flags", PERIOD, ("revenue",), o.company_chain("true")))

# ---- level metrics and reports ------------------------------------------------------

DEAL = [f"daily_deal_{m}" for m in METRICS]
PRE = [f"daily_pre_deal_{m}" for m in METRICS]
DELTA = [f"delta_daily_{m}" for m in METRICS]
LY = [f"ly_{c}" for c in (*DEAL, *PRE)]
LY_DELTA = [f"ly_delta_daily_{m}" for m in METRICS]
YOY = [f"yoy_delta_daily_{m}" for m in METRICS]


def _register_level(level: str) -> None:
    register(f"deal_metrics_{level}", from_events(lambda p: p.deal_metrics(level)),
             o.rounded(f"deal_{level}", DEAL))
    register(f"pre_deal_metrics_{level}", from_events(lambda p: p.pre_deal_metrics(level)),
             o.rounded(f"pre_{level}", PRE))
    register(f"deal_growth_{level}", from_events(lambda p: p.growth(level)),
             o.rounded(f"growth_{level}", [*DEAL, *PRE, *DELTA]))
    register(f"final_{level}", from_events(lambda p: p.final(level)),
             o.rounded(f"final_{level}", [*DEAL, *PRE, *DELTA, *LY]))
    register(f"report_{level}", from_events(lambda p: p.report(level)),
             o.rounded(f"report_{level}", [*DEAL, *PRE, *DELTA, *LY, *LY_DELTA]))
    keys = compare.REPORT_KEYS[level]
    yoy = ", ".join(
        f"round(delta_daily_{m} - ly_delta_daily_{m}, 6) AS yoy_delta_daily_{m}" for m in METRICS
    )
    register(
        f"yoy_delta_{level}",
        from_events(lambda p: compare.with_yoy_delta(p.report(level)).select(*keys, *YOY)),
        o.sql(f"SELECT {', '.join(keys)}, {yoy} FROM report_{level}"),
    )


for _level in LEVELS:
    _register_level(_level)



register("report_brand_all_marketplaces",
         from_events(lambda p: p.report("brand"), scope=EVERYWHERE),
         o.rounded("report_brand", [*DEAL, *PRE, *DELTA, *LY, *LY_DELTA], (), o.EVERYWHERE))



def _register_approximate(level: str) -> None:
    """Customers from sketches. Below 1,536 customers a group a sketch holds them one by one, so at the
    scale of the twins the exact rows are the expected ones; tests state the error beyond."""
    register(f"deal_metrics_{level}_approx",
             from_events(lambda p: p.deal_metrics(level), approx=True),
             o.rounded(f"deal_{level}", DEAL))
    register(f"pre_deal_metrics_{level}_approx",
             from_events(lambda p: p.pre_deal_metrics(level), approx=True),
             o.rounded(f"pre_{level}", PRE))


for _level in LEVELS:
    _register_approximate(_level)
register("report_brand_approx", from_events(lambda p: p.report("brand"), approx=True),
         o.rounded("report_brand", [*DEAL, *PRE, *DELTA, *LY, *LY_DELTA]))


def _register_truncated(level: str) -> None:
    """Parity with integer division: units and customers are truncated, the rest is not."""
    for name, metrics_of, twin, columns in (
        ("deal_metrics", lambda p: p.deal_metrics(level), o.deal_metrics(level, "//"), DEAL),
        ("pre_deal_metrics", lambda p: p.pre_deal_metrics(level),
         o.pre_deal_metrics(level, "//"), PRE),
    ):
        exact = [f"round({c}, 6) AS {c}" for c in columns if c.endswith(("ops", "subscribers"))]
        register(f"{name}_{level}_trunc", from_events(metrics_of, integer_daily=True),
                 o.sql(f"SELECT * REPLACE ({', '.join(exact)}) FROM ({twin})"))


for _level in LEVELS:
    _register_truncated(_level)


def _register_keys(level: str) -> None:
    keys = ", ".join(LEVELS[level].keys)
    register(
        f"deal_keys_{level}", from_events(lambda p: metrics.deal_keys(p.flags, LEVELS[level])),
        o.sql(f"SELECT DISTINCT {keys}, event_name, event_year FROM flags"
              " WHERE period_type = 'DEAL'"),
    )


for _level in ("brand", "company", "category"):
    _register_keys(_level)

# ---- v1 report ----------------------------------------------------------------------

V1_DEAL = [c for c in item_growth.V1_DEAL if not c.endswith("subscribers")]
V1_PRE = [c for c in item_growth.V1_PRE_DEAL if not c.endswith("subscribers")]
V1_ALL = [*item_growth.V1_DEAL, *item_growth.V1_PRE_DEAL]
register("deal_metrics_v1", from_growth(lambda p: p.deal_metrics), o.rounded("deal_v1", V1_DEAL))
register("pre_deal_metrics_v1", from_growth(lambda p: p.pre_deal_metrics),
         o.rounded("pre_v1", V1_PRE))
register("subscriber_metrics_v1", from_growth(lambda p: p.subscriber_metrics),
         o.rounded("subscribers_v1", ("avg_deal_subscribers", "avg_pre_deal_subscribers")))
register("deal_growth_v1", from_growth(lambda p: p.growth), o.rounded("growth_v1", V1_ALL))
V1_MONEY = ("ops", "ads_amt", "subscription_amt")
register("deal_metrics_v1_trunc", from_growth(lambda p: p.deal_metrics, integer_daily=True),
         o.rounded("deal_v1_trunc", [c for c in V1_DEAL if c.endswith(V1_MONEY)]))
register("pre_deal_metrics_v1_trunc",
         from_growth(lambda p: p.pre_deal_metrics, integer_daily=True),
         o.rounded("pre_v1_trunc", [c for c in V1_PRE if c.endswith(V1_MONEY)]))
register("deal_growth_v1_trunc", from_growth(lambda p: p.growth, integer_daily=True),
         o.rounded("growth_v1_trunc",
                   [c for c in V1_ALL if c.endswith((*V1_MONEY, "subscribers"))]))
register("report_item_v1", from_growth(lambda p: p.report),
         o.rounded("report_v1", [*V1_ALL, *(f"ly_{c}" for c in V1_ALL)]))

# ---- cohorts ------------------------------------------------------------------------

register("purchase_history", from_history(lambda h: h), o.sql("SELECT * FROM history"))
register("gap_bucket", from_history(cohorts.with_gap_bucket), o.sql("SELECT * FROM buckets"))
register("cohort_table", from_cohort(lambda c: c), o.sql("SELECT * FROM cohort"))
register("cohort_table_elapsed",
         from_history(lambda h: cohorts.cohort_table(h, "elapsed_days")),
         o.sql("SELECT * FROM cohort_elapsed"))
register("first_time_by_item", from_cohort(cohorts.first_time_by_item), o.sql("""
SELECT vendor_code, item_id, CAST(sum(customers) AS BIGINT) AS customers FROM cohort
WHERE gap_bucket = 'new to brand' GROUP BY ALL"""))
register("retention_mix", from_cohort(cohorts.retention_mix), o.sql("""
SELECT item_id, gap_bucket, CAST(sum(customers) AS BIGINT) AS customers,
  CAST(list_position(['new to brand', '1 mo', '2 mo', '3 mo', '> 3 mo'], gap_bucket) - 1 AS INT)
    AS seq
FROM cohort GROUP BY ALL"""))
register("purchase_type_share", from_cohort(cohorts.purchase_type_share), o.sql("""
SELECT *, round(customers * 100 / sum(customers) OVER v, 6) AS pct,
  CASE WHEN round(customers * 100 / sum(customers) OVER v, 1) >= 2 THEN gap_bucket ELSE '' END
    AS label
FROM (SELECT vendor_code, gap_bucket, CAST(sum(customers) AS BIGINT) AS customers FROM cohort
  GROUP BY ALL)
WINDOW v AS (PARTITION BY vendor_code)"""))
register("return_purchases", from_cohort(cohorts.return_purchases), o.sql("""
SELECT vendor_code, item_id, gap_bucket, CAST(sum(customers) AS BIGINT) AS customers FROM cohort
WHERE gap_bucket <> 'new to brand' GROUP BY ALL"""))
register("returns_over_time", from_cohort(cohorts.returns_over_time), o.sql("""
SELECT CAST(year(order_ts) AS INT) AS order_year, CAST(month(order_ts) AS INT) AS order_month,
  vendor_code, gap_bucket, CAST(sum(customers) AS BIGINT) AS customers,
  concat_ws('/', year(order_ts), month(order_ts)) AS order_year_month
FROM cohort WHERE gap_bucket = '1 mo' GROUP BY ALL"""))
register("time_to_return", from_history(cohorts.time_to_return), o.sql("""
SELECT vendor_code, count(*) AS returning_customers, round(avg(days), 6) AS mean_days,
  round(quantile_cont(days, 0.25), 6) AS p25_days,
  round(quantile_cont(days, 0.5), 6) AS p50_days,
  round(quantile_cont(days, 0.75), 6) AS p75_days, CAST(max(days) AS INT) AS max_days
FROM (
  SELECT vendor_code, date_sub('day', min(order_ts), min(order_ts) FILTER (purchase_rank = 2))
    AS days
  FROM history GROUP BY vendor_code, customer_id)
WHERE days IS NOT NULL GROUP BY vendor_code"""))

register(
    "gap_bucket_clock_times",
    lambda spark, sf_dir: cohorts.with_gap_bucket(
        history.purchase_history(clicked_orders(spark, sf_dir))
    ),
    o.sql("SELECT * FROM clicked_buckets"),
)

# ---- shares of new customers --------------------------------------------------------


def _share(level: str, *extra: str) -> Callable[[EventPipeline], DataFrame]:
    return lambda p: shares.new_customer_share(p.flags, LEVELS[level], extra)


for _level in ("item", "brand", "company"):
    register(f"new_share_{_level}", from_events(_share(_level)),
             o.rounded(f"share_{_level}", ("new_share", "ops")))
register(
    "top_new_share",
    from_events(lambda p: shares.top_new_share(_share("brand")(p), TOP)),
    o.sql(f"""SELECT * REPLACE (round(new_share, 6) AS new_share) FROM share_brand
WHERE period_type = 'DEAL'
ORDER BY share_brand.new_share DESC, ops DESC, brand_code, event_name, event_year LIMIT {TOP}"""),
)


def _peers(source: str) -> str:
    peers = "PARTITION BY category_code, event_name, event_year, period_type"
    return o.sql(f"""
SELECT * REPLACE (round(new_share, 6) AS new_share, round(ops, 6) AS ops),
  round(avg(s.new_share) OVER ({peers}), 6) AS peer_mean_share,
  round(s.new_share - avg(s.new_share) OVER ({peers}), 6) AS share_vs_peers,
  CASE WHEN s.new_share IS NOT NULL THEN round(percent_rank() OVER (
    {peers}, s.new_share IS NULL ORDER BY s.new_share), 6) END AS peer_percent_rank
FROM {source} s""")


register("peer_comparison",
         from_events(lambda p: shares.peer_comparison(_share("brand", "category_code")(p))),
         _peers("share_brand_category"))
register("peer_comparison_item",
         from_events(lambda p: shares.peer_comparison(_share("item", "category_code")(p))),
         _peers("share_item_category"))
register("category_acquisition", from_events(_share("category")),
         o.rounded("share_category", ("new_share", "ops")))


def _lift(source: str, keys: str) -> str:
    of = "max(new_share) FILTER (period_type = '{}')"
    deal, pre = of.format("DEAL"), of.format("PRE_DEAL")
    return o.sql(f"""
SELECT {keys}, round({deal}, 6) AS deal_new_share, round({pre}, 6) AS pre_deal_new_share,
  round({deal} - {pre}, 6) AS new_share_lift FROM {source} GROUP BY ALL""")


register("ntb_share_lift", from_events(lambda p: shares.new_share_lift(_share("brand")(p))),
         _lift("share_brand", "brand_code, event_name, event_year"))
register("ntb_share_lift_event", from_events(lambda p: shares.new_share_lift(_share("event")(p))),
         _lift("share_event", "event_name, event_year"))

# ---- files, samples and cleaning -----------------------------------------------------------

ORDERS_FILE = (
    "vendor_code string, item_id long, customer_id long, order_ts timestamp_ntz, "
    "condition_code int, line_id string"
)


def _through_file(sep: str) -> Callable:
    """Order lines written to a text file in the shared folder and read back."""
    def build(spark, sf_dir):
        folder = shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")
        path = f"{folder}/tidemark/orders-{uuid4().hex}"
        write_csv(load_testdata(spark, sf_dir).cohort_orders, path, sep)
        return read_orders_csv(spark, path, sep, ORDERS_FILE)
    return build


register("orders_csv", _through_file(","), o.sql("SELECT * FROM cohort_orders"))
register("orders_tsv", _through_file("\t"), o.sql("SELECT * FROM cohort_orders"))
register(
    "sample_orders",
    from_sources(lambda s: samples.sample_orders(s.cohort_orders, SAMPLE, seed=7)),
    o.sql(f"SELECT * FROM cohort_orders ORDER BY md5('7-' || line_id), ALL LIMIT {SAMPLE}"
          .replace(", ALL", ", vendor_code, item_id, customer_id, order_ts, condition_code")),
)

RAW = """
SELECT line_id, CASE o_custkey % 12 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity'
    WHEN 3 THEN '90071992547409' || lpad(CAST(o_custkey AS VARCHAR), 8, '0')
    WHEN 4 THEN o_custkey || '.5' WHEN 5 THEN o_custkey || 'e3' ELSE o_custkey || '.0' END
    AS customer_id,
  CAST(l_suppkey AS VARCHAR) AS vendor_id,
  CASE l_linenumber % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
    WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
    WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y %H:%M')
    WHEN 3 THEN strftime(o_orderdate, '%d %b %Y') ELSE 'unknown' END AS order_ts
FROM order_lines"""
o.STEPS["raw_lines"] = RAW
register("clean_orders", lambda spark, sf_dir: samples.clean_orders(raw_orders(spark, sf_dir)),
         o.sql("""
SELECT line_id, CAST(CAST(CASE WHEN contains(customer_id, '.5')
    -- a half goes to the even neighbour
    THEN CAST(2 * round(CAST(replace(customer_id, '.5', '') AS BIGINT) / 2 + 0.25, 0)
      AS DECIMAL(38,10))
    ELSE try_cast(customer_id AS DECIMAL(38,10)) END AS DECIMAL(28,0)) AS VARCHAR) AS customer_id,
  CAST(CAST(vendor_id AS BIGINT) AS VARCHAR) AS vendor_id,
  try_strptime(order_ts, ['%Y-%m-%d %H:%M:%S', '%Y/%m/%d', '%m/%d/%Y %H:%M', '%d %b %Y'])
    AS order_ts
FROM raw_lines"""))
