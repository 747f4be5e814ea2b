"""Shares of new customers: by entity, against peers, event against normal days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import Level
from .keys import join_groups
from .periods import DEAL, PRE_DEAL

PERIOD = ("event_name", "event_year", "period_type")


def new_customer_share(flags: DataFrame, level: Level, extra_keys=()) -> DataFrame:
    """Customers, new customers, their share, units and sales of each entity in the deal
    and in the benchmark days of each event."""
    keys = [*level.keys, *[k for k in extra_keys if k not in level.keys], *PERIOD]
    if level.required:
        flags = flags.filter(F.col(level.required).isNotNull())
    new = reduce(lambda a, b: F.greatest(a, b), (F.col(f) for f in level.flags))
    per_customer = flags.groupBy(*keys, "customer_id").agg(
        F.sum("units").alias("units"), F.sum("revenue").alias("ops"), F.max(new).alias("new")
    )
    known = F.col("customer_id").isNotNull()
    totals = per_customer.groupBy(*keys).agg(
        F.count(F.when(known, 1)).alias("customers"),
        F.count(F.when(known & (F.col("new") == 1), 1)).alias("new_customers"),
        F.sum("units").alias("shipped_units"),
        F.sum("ops").alias("ops"),
    )
    return totals.withColumn("new_share", F.try_divide("new_customers", "customers"))


def top_new_share(share: DataFrame, k: int, period: str = DEAL) -> DataFrame:
    """The k entities and events with the highest share, then the highest sales."""
    rows = share.filter(F.col("period_type") == period)
    rest = [c for c in rows.columns if c not in ("new_share", "ops")]
    return rows.orderBy(F.desc("new_share"), F.desc("ops"), *rest).limit(k)


# Digits of a share by which it is ranked: DIGITS values each. Shares that agree in two digits, that
# is in 24 bits, are sorted together.
DIGITS = 1 << 12


def _running(peers: DataFrame, group, order: str, name: str) -> DataFrame:
    """`name`: the sum of n over the rows of the group that come before."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return peers.withColumn(name, F.coalesce(F.sum("n").over(before), F.lit(0)))


def share_ranks(share: DataFrame, peers) -> DataFrame:
    """For each different share of a peer group: how many peers there are, and how many below it.

    Ranks are added up from digits: the peers with a lower first digit, with the same first and a
    lower second, and with the same two and a lower share. Each window holds at most DIGITS + 1
    rows of a group, or the different shares that agree in both digits, so a group of any number of
    different shares is spread.
    """
    first = F.floor(F.col("new_share") * DIGITS)
    counts = share.filter(F.col("new_share").isNotNull()).groupBy(*peers, "new_share").agg(
        F.count("*").alias("n")
    ).withColumns({
        "first": first, "second": F.floor(F.col("new_share") * DIGITS * DIGITS) - first * DIGITS,
    })
    one, two = [*peers, "first"], [*peers, "first", "second"]
    by_first = counts.groupBy(*one).agg(F.sum("n").alias("n"))
    by_second = counts.groupBy(*two).agg(F.sum("n").alias("n"))
    totals = by_first.groupBy(*peers).agg(F.sum("n").alias("peers"))
    ranks = _running(counts, two, "new_share", "within").drop("n")
    ranks = join_groups(ranks, _running(by_second, one, "second", "below_second").drop("n"), two)
    ranks = join_groups(ranks, _running(by_first, peers, "first", "below_first").drop("n"), one)
    return join_groups(ranks, totals, peers).select(
        *peers, "new_share", "peers",
        (F.col("below_first") + F.col("below_second") + F.col("within")).alias("below"))


def peer_comparison(share: DataFrame, within: str = "category_code") -> DataFrame:
    """Each entity's share against the mean share of its peers, and its percent rank.

    Peers are the entities of the same category in the same event and period that have
    a share; an entity without one stays, without rank. Ranks come from counts per distinct
    share, added up digit by digit, so no task sorts a whole category.
    """
    peers = [within, *PERIOD]
    ranks = share_ranks(share, peers)
    means = share.groupBy(*peers).agg(F.avg("new_share").alias("mean_share"))
    mean = F.col("mean_share")
    ranked = F.when(F.col("peers") > 1, F.col("below") / (F.col("peers") - 1)).otherwise(0.0)
    rank = F.when(F.col("new_share").isNotNull(), ranked)
    compared = join_groups(share, means, peers, "left")
    return join_groups(compared, ranks, [*peers, "new_share"], "left").select(
        *share.columns,
        mean.alias("peer_mean_share"),
        (F.col("new_share") - mean).alias("share_vs_peers"),
        rank.alias("peer_percent_rank"),
    )


def new_share_lift(share: DataFrame) -> DataFrame:
    """Share of new customers in the deal days minus the share in the benchmark days."""
    keys = [
        c for c in share.columns
        if c not in ("period_type", "customers", "new_customers", "shipped_units", "ops",
                     "new_share")
    ]

    def of(period: str):
        return F.max(F.when(F.col("period_type") == period, F.col("new_share")))

    return share.groupBy(*keys).agg(
        of(DEAL).alias("deal_new_share"), of(PRE_DEAL).alias("pre_deal_new_share")
    ).withColumn("new_share_lift", F.col("deal_new_share") - F.col("pre_deal_new_share"))
