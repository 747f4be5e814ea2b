"""The v1 item growth report: unstandardised windows against 91 days before."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events, firsts, item_growth, orders, periods
from ..scope import BENCHMARK_DAYS_V1, Scope
from ..session import Staging
from ..sources.tables import Sources


@dataclass
class ItemGrowthPipeline:
    """The stages as lazy DataFrames, each built once.

    With `staging`, the base lines and the promotion windows (read by both periods), the orders of
    both periods (read by the first purchases and by each summary), the two summaries (each read by
    an item and a brand aggregation) and, for the report, the growth rows (read by both years) are
    written when they are first used, and dropped when its owner closes it; without, everything is
    one lazy plan.
    """

    src: Sources
    run_date: date
    scope: Scope
    benchmark_days: int = BENCHMARK_DAYS_V1
    integer_daily: bool = False
    staging: Staging | None = None

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        return self.staging.put(df, name) if self.staging else df

    @cached_property
    def base_lines(self) -> DataFrame:
        lines = orders.base_lines_v1(self.src, self.scope, self.run_date)
        return self._stage(lines, "base_lines_v1")

    @cached_property
    def promo_events(self) -> DataFrame:
        return events.promo_events_v1(
            self.src.promo_lines, self.src.promotions, self.scope, self.run_date
        )

    @cached_property
    def promos(self) -> DataFrame:
        return self._stage(events.merge_promo_windows(self.promo_events), "promo_windows")

    @cached_property
    def ranges(self) -> DataFrame:
        return events.benchmark_ranges(self.promos, self.benchmark_days)

    @cached_property
    def _deal_matches(self) -> DataFrame:
        return periods.deal_orders_v1(self.base_lines, self.promos, self.run_date)

    @cached_property
    def _pre_deal_matches(self) -> DataFrame:
        return periods.match_pre_deal_v1(self.base_lines, self.ranges, self.benchmark_days)

    @cached_property
    def deal_orders(self) -> DataFrame:
        """Amounts are looked up for the matched orders only, here and below."""
        return orders.attach_amounts_v1(self._deal_matches, self.src.contribution)

    @cached_property
    def pre_deal_orders(self) -> DataFrame:
        return orders.attach_amounts_v1(
            self._pre_deal_matches, self.src.contribution
        ).distinct()

    @cached_property
    def first_purchases(self) -> DataFrame:
        """A minimum needs neither the amounts nor distinct orders."""
        columns = ("customer_id", "brand_code", "order_date")
        return firsts.first_purchases(
            self._deal_matches.select(*columns).unionByName(
                self._pre_deal_matches.select(*columns)
            )
        )

    @cached_property
    def _period_orders(self) -> DataFrame:
        """The rows of `deal_orders` and, not yet distinct, of `pre_deal_orders`: one look-up of amounts."""
        matches = self._deal_matches.unionByName(self._pre_deal_matches, allowMissingColumns=True)
        with_amounts = orders.attach_amounts_v1(matches, self.src.contribution)
        return self._stage(with_amounts, "period_orders_v1")

    def _flagged(self, period_orders: DataFrame) -> DataFrame:
        return firsts.flag_new_by_date(
            period_orders, firsts.first_purchases(self._period_orders)
        )

    @cached_property
    def deal_summary(self) -> DataFrame:
        deal = self._period_orders.filter(F.col("period_type") == periods.DEAL)
        return self._stage(self._flagged(deal), "deal_summary")

    @cached_property
    def pre_deal_summary(self) -> DataFrame:
        pre = self._period_orders.filter(F.col("period_type") == periods.PRE_DEAL)
        summary = self._flagged(pre.drop("event_duration_days").distinct())
        return self._stage(summary, "pre_deal_summary")

    @cached_property
    def deal_metrics(self) -> DataFrame:
        return item_growth.deal_metrics_v1(
            self.deal_summary, self.src.item_vendor, self.scope, self.run_date,
            self.integer_daily,
        )

    @cached_property
    def pre_deal_metrics(self) -> DataFrame:
        return item_growth.pre_deal_metrics_v1(
            self.pre_deal_summary, self.benchmark_days, self.integer_daily
        )

    @cached_property
    def subscriber_metrics(self) -> DataFrame:
        return item_growth.subscriber_metrics_v1(
            self.src.subscriptions_daily, self.promos, self.scope, self.benchmark_days
        )

    @cached_property
    def growth(self) -> DataFrame:
        return item_growth.deal_growth_v1(
            self.deal_metrics, self.pre_deal_metrics, self.subscriber_metrics,
            self.src.vendor_company, self.scope,
        )

    @cached_property
    def report(self) -> DataFrame:
        return item_growth.report_item_v1(self._stage(self.growth, "growth_v1"))
