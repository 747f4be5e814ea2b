"""Parameters shared by the operators; every default can be overridden."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

BENCHMARK_DAYS = 29
BENCHMARK_DAYS_V1 = 91
LOOKBACK_DAYS = 365
MIN_FREQUENCY = 3


@dataclass(frozen=True)
class Scope:
    """Which marketplace, categories and history a run covers.

    `categories` maps the codes in scope to the names reports show. A region or marketplace of None
    does not restrict the rows: lines then meet the items, vendors and amounts of their own place.
    """

    categories: dict
    region_id: int | None = 1
    marketplace_id: int | None = 7
    excluded_conditions: tuple[int, ...] = (6,)  # 6 = cancelled or fraudulent
    history_days: int = 730

    @property
    def open_places(self) -> tuple[str, ...]:
        """Columns that tell apart the places that the scope leaves open; joins match on them."""
        named = {"marketplace_id": self.marketplace_id, "region_id": self.region_id}
        return tuple(column for column, value in named.items() if value is None)

    def first_day(self, run_date: date) -> date:
        return run_date - timedelta(days=self.history_days)
