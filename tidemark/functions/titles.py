"""Promotion titles to sales events: an ordered rule table compiled to one CASE."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class EventRule(NamedTuple):
    label: str
    patterns: tuple[str, ...]
    month: int | None = None  # v3 only: the start month the rule is limited to


# Event labels, their title patterns (LIKE, on the upper-cased title)
# and gate months, in the order in which they are tried. Patterns that another
# pattern of the same rule already covers are left out.
EVENT_RULES = (
    EventRule("BSS", ("%BSS%", "%BIG SPRING SALE%")),
    EventRule("PRIME DAY", ("%PRIME%DAY%", "%PD%", "%PEBD%"), month=7),
    EventRule("PBDD", ("%PBDD%",)),
    EventRule("BLACK FRIDAY", ("%BF%", "%BLACK%FRIDAY%")),
    EventRule("CYBER MONDAY", ("%CYBER%MONDAY%", "%CM%")),
    EventRule("BOXING WEEK", ("%BOXING WEEK%", "%BOXING DAY%")),
    EventRule("T5/11/12", ("%T5%", "%T11%", "%T12%")),
    EventRule("BACK TO SCHOOL", ("%BACK%TO%SCHOOL%",)),
    EventRule("BACK TO UNIVERSITY", ("%BACK%TO%UNIVERSITY%",)),
    EventRule("NYNY", ("%NYNY%",)),
    EventRule("MOTHERS DAY", ("%MOTHER%DAY%",), month=5),
    EventRule("FATHERS DAY", ("%FATHER%DAY%",)),
    EventRule("VALENTINES DAY", ("%VALENTINE%DAY%",)),
    EventRule("GIFT MANIA", ("%GIFT%MANIA%",)),
    EventRule("HALLOWEEN", ("%HALLOWEEN%",)),
    EventRule("HOLIDAY", ("%HOLIDAY%",)),
    EventRule("LUNAR NEW YEAR", ("%LUNAR%NEW%YEAR%",)),
    EventRule("DAILY ESSENTIALS", ("%DAILY%ESSENTIALS%",)),
    EventRule("BEAUTY HAUL", ("%BEAUTY%HAUL%",)),
    EventRule("PET DAY", ("%PET%DAY%", "%PET%MONTH%"), month=5),
    EventRule("HEALTH & WELLNESS MONTH", ("%HEALTH%WELLNESS%",)),
    EventRule("GAMING MONTH", ("%GAMING%MONTH%",)),
    EventRule("BABY SAVINGS", ("%BABY%SAVINGS%",)),
    EventRule("BEAUTY WEEK", ("%BEAUTY%WEEK%",)),
    EventRule("DIWALI", ("%DIWALI%",)),
    EventRule("MOVEMBER", ("%MOVEMBER%",)),
    EventRule("FLASH SALE", ("%FLASH SALE%",)),
)
OTHER = "OTHER"
NO_PROMOTION = "NO_PROMOTION"
GATE_EARLY_DAY = 25  # a gate also admits starts from this day of the month before

# Which event an order line keeps when several claim it.
EVENT_PRIORITIES = {
    "PRIME DAY": 1,
    "BSS": 1,
    "PBDD": 1,
    "T5/11/12": 1,
    "BLACK FRIDAY": 2,
    "CYBER MONDAY": 3,
    "BOXING WEEK": 4,
    "NYNY": 5,
}
LOWEST_PRIORITY = 99


def _in_gate(start: Column, month: int) -> Column:
    early = (F.month(start) == month - 1) & (F.dayofmonth(start) >= GATE_EARLY_DAY)
    return (F.month(start) == month) | early


def classify_event(
    title: Column, start: Column | None = None, key: Column | None = None, rules=EVENT_RULES
) -> Column:
    """Label of the first rule that matches the title.

    With `start` the month gates apply (v2/v3); a title that fails its gate falls
    through to the rules after it. Without `start` no rule is gated (v1).
    A NULL promotion `key` gives NO_PROMOTION.
    """
    upper = F.upper(title)
    label = F.when(key.isNull(), NO_PROMOTION) if key is not None else F
    for rule in rules:
        hit = reduce(lambda a, b: a | b, (upper.like(p) for p in rule.patterns))
        if start is not None and rule.month is not None:
            hit = hit & _in_gate(start, rule.month)
        label = label.when(hit, rule.label)
    return label.otherwise(OTHER)


def event_priority(event: Column) -> Column:
    label = F
    for name, rank in EVENT_PRIORITIES.items():
        label = label.when(event == name, rank)
    return label.otherwise(LOWEST_PRIORITY)
