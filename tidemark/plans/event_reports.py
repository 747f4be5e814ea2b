"""The five-level event report: from the input tables to item, brand, company by
category, category and event reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import compare, events, firsts, metrics, orders, periods, sketches
from ..operators.metrics import LEVELS
from ..operators.prefilter import key_filter, keep_marked
from ..scope import BENCHMARK_DAYS, LOOKBACK_DAYS, MIN_FREQUENCY, Scope
from ..session import Staging
from ..sources.tables import Sources


@dataclass
class EventPipeline:
    """The stages as lazy DataFrames, each built once.

    With `staging`, `base_lines` (read by both periods and by the first purchases), the deal lines
    (read by both periods, and for the items that have a window at all), the orders of some period
    (read for their amounts, and for the lines that need amounts at all) and the flag table (read
    by every level) are written when they are first used, and dropped when its owner closes it;
    without, everything is one lazy plan. `approx` estimates the numbers of customers from sketches
    that all levels merge, instead of grouping by customer for each of them.
    """

    src: Sources
    run_date: date
    scope: Scope
    benchmark_days: int = BENCHMARK_DAYS
    benchmark_gap_days: int = 1
    lookback_days: int | None = LOOKBACK_DAYS
    min_frequency: int = MIN_FREQUENCY
    null_keys_are_new: bool = True
    integer_daily: bool = False
    approx: bool = False
    staging: Staging | None = None

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        return self.staging.put(df, name) if self.staging else df

    @cached_property
    def base_lines(self) -> DataFrame:
        return self._stage(orders.base_lines(self.src, self.scope, self.run_date), "base_lines")

    @cached_property
    def subscribers(self) -> DataFrame:
        return orders.daily_subscribers(self.src.subscriptions_daily, self.scope, self.run_date)

    @cached_property
    def promo_events(self) -> DataFrame:
        return events.promo_events(
            self.src.promo_lines, self.src.promotions, self.src.items, self.scope, self.run_date
        )

    @cached_property
    def resolved(self) -> DataFrame:
        return events.resolve_overlaps(self.promo_events)

    @cached_property
    def standards(self) -> DataFrame:
        return events.standard_event_dates(self.resolved, self.min_frequency)

    @cached_property
    def consolidated(self) -> DataFrame:
        return events.consolidate_promos(self.resolved, self.standards)

    @cached_property
    def deal_lines(self) -> DataFrame:
        return self._stage(events.with_event_windows(
            self.consolidated, self.run_date, self.benchmark_days, self.benchmark_gap_days
        ), "deal_lines")

    @cached_property
    def windows(self) -> DataFrame:
        return events.item_windows(self.deal_lines)

    @cached_property
    def period_orders(self) -> DataFrame:
        """Benchmark and deal orders with amounts and subscribers.

        Amounts are looked up here, for the orders of some period only, and not for
        the whole history. Amounts of other lines are dropped before they are shuffled.
        """
        matched = self._stage(periods.match_periods(
            self.deal_lines, self.windows, self.base_lines, self.benchmark_days
        ), "matched_orders")
        amounts = keep_marked(
            self.src.contribution, ["line_id"], key_filter(matched, ["line_id"])
        )
        with_amounts = orders.attach_amounts(matched, amounts, self.scope.marketplace_id)
        return periods.with_subscribers(with_amounts, self.subscribers)

    @cached_property
    def firsts(self) -> DataFrame:
        return firsts.first_purchase_levels(self.base_lines, self.run_date, self.lookback_days)

    @cached_property
    def flags(self) -> DataFrame:
        flagged = firsts.flag_new_by_period(
            self.period_orders, self.firsts, self.null_keys_are_new
        )
        return self._stage(flagged, "new_customer_flags")

    @cached_property
    def event_members(self) -> DataFrame:
        """What takes part in each event; the event level counts it three times."""
        return self._stage(metrics.event_members(self.flags), "event_members")

    @cached_property
    def event_summary(self) -> DataFrame:
        """Sketches by item, event and period, which every level merges."""
        return self._stage(sketches.event_summary(self.flags), "event_summary")

    def _members(self, level: str) -> DataFrame | None:
        return self.event_members if level == "event" else None

    def deal_metrics(self, level: str, whole_year: bool = False) -> DataFrame:
        if self.approx:
            return sketches.approximate_deal_metrics(
                self.event_summary, LEVELS[level], self.integer_daily, whole_year
            )
        return metrics.deal_metrics(
            self.flags, LEVELS[level], self.integer_daily, whole_year, self._members(level)
        )

    def pre_deal_metrics(self, level: str) -> DataFrame:
        if self.approx:
            return sketches.approximate_pre_deal_metrics(
                self.event_summary, LEVELS[level], self.benchmark_days, self.integer_daily
            )
        return metrics.pre_deal_metrics(
            self.flags, LEVELS[level], self.benchmark_days, self.integer_daily,
            self._members(level),
        )

    def growth(self, level: str, whole_year: bool = False) -> DataFrame:
        return compare.deal_vs_benchmark(
            self.deal_metrics(level, whole_year), self.pre_deal_metrics(level), LEVELS[level]
        )

    def final(self, level: str) -> DataFrame:
        return compare.final_metrics(
            self.growth(level), self.growth(level, whole_year=True), LEVELS[level]
        )

    def report(self, level: str) -> DataFrame:
        return compare.level_report(self.final(level), LEVELS[level])


def run_event_reports(
    pipeline: EventPipeline, write: Callable[[DataFrame, str], None], levels=tuple(LEVELS)
) -> None:
    """Build and write the reports; the levels share staged tables, which are dropped at the end.

    A pipeline that has a staging of its own keeps it: its owner drops the tables.
    """
    if pipeline.staging is not None:
        for level in levels:
            write(pipeline.report(level), level)
        return
    with Staging(pipeline.src.shipments.sparkSession) as staging:
        run_event_reports(replace(pipeline, staging=staging), write, levels)
