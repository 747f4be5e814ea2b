"""The v2 chain: one company's orders around standardised events, with new-customer flags."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events, firsts, orders, periods
from ..scope import BENCHMARK_DAYS_V1, LOOKBACK_DAYS, MIN_FREQUENCY, Scope
from ..session import Staging
from ..sources.tables import Sources


@dataclass
class CompanyPipeline:
    """The stages as lazy DataFrames, each built once.

    Unlike v3, an item's best event is chosen by month and not by order line, lines whose event has no
    standard dates have no event, the run date's own orders count, and the benchmark is 91 days.
    `company=None` takes all companies. With `staging`, the base orders (read by both
    periods and the first purchases) and the events are written when they are first used.
    """

    src: Sources
    run_date: date
    scope: Scope
    company: str | None = None
    benchmark_days: int = BENCHMARK_DAYS_V1
    lookback_days: int | None = LOOKBACK_DAYS
    min_frequency: int = MIN_FREQUENCY
    null_keys_are_new: bool = True
    staging: Staging | None = None

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        return self.staging.put(df, name) if self.staging else df

    @cached_property
    def base_orders(self) -> DataFrame:
        base = orders.base_orders_company(self.src, self.scope, self.run_date, self.company)
        return self._stage(base, "company_orders")

    @cached_property
    def subscribers(self) -> DataFrame:
        return orders.daily_subscribers(
            self.src.subscriptions_daily, self.scope, self.run_date, any_region=True
        )

    @cached_property
    def resolved(self) -> DataFrame:
        found = events.promo_events(
            self.src.promo_lines, self.src.promotions, self.src.items, self.scope, self.run_date
        )
        return self._stage(
            events.resolve_overlaps(found, ("item_id", "event_month")), "events_by_month"
        )

    @cached_property
    def consolidated(self) -> DataFrame:
        standards = events.standard_event_dates(self.resolved, self.min_frequency)
        return events.consolidate_promos(self.resolved, standards, fallback=False)

    @cached_property
    def deal_orders(self) -> DataFrame:
        return periods.deal_orders_v2(self.base_orders, self.consolidated, self.run_date)

    @cached_property
    def ranges(self) -> DataFrame:
        return events.benchmark_ranges(self.consolidated, self.benchmark_days)

    @cached_property
    def pre_deal_orders(self) -> DataFrame:
        return periods.pre_deal_orders_v1(self.base_orders, self.ranges, self.benchmark_days)

    @cached_property
    def firsts(self) -> DataFrame:
        return firsts.first_purchase_levels(self.base_orders, self.run_date, self.lookback_days)

    @cached_property
    def period_orders(self) -> DataFrame:
        """Deal and benchmark orders with subscribers and the days of both periods.

        Benchmark orders have no duration. A deal row's own benchmark window is the 29 days of
        `deal_orders_v2`, a benchmark row's the days that it was found in.
        """
        start = F.col("promo_start_date")
        benchmark = self.pre_deal_orders.withColumns(
            events.benchmark_window(start, self.benchmark_days)
        )
        both = self.deal_orders.unionByName(benchmark, allowMissingColumns=True).withColumns(
            {"deal_start_date": start, "deal_end_date": F.col("promo_end_date")}
        )
        return periods.with_subscribers(both, self.subscribers)

    @cached_property
    def flags(self) -> DataFrame:
        return firsts.flag_new_by_period(self.period_orders, self.firsts, self.null_keys_are_new)
