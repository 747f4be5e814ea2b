"""Ranks among peers by digits, against sorting."""

from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import shares

SHARE = ("brand_code string, category_code int, event_name string, event_year int, period_type string, "
         "new_share double")
PEERS = ["category_code", "event_name", "event_year", "period_type"]
values = st.one_of(
    st.none(), st.sampled_from([0.0, 1.0, 0.5, 1 / 3, 2 / 3, 0.5 + 2 ** -13, 0.5 + 2 ** -30]),
    st.fractions(0, 1, max_denominator=50).map(float))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), values), min_size=1, max_size=40))
@example([(1, 0.5 + i * 2 ** -40) for i in range(30)] + [(1, 0.5)] * 3 + [(None, 1.0), (None, None)])
def test_percent_rank_equals_sorting(spark, drawn):
    share = spark.createDataFrame(
        [(str(i), category, "BSS", 2001, "DEAL", value) for i, (category, value) in enumerate(drawn)],
        SHARE)
    expected = []
    for i, (category, value) in enumerate(drawn):
        peers = [v for c, v in drawn if c == category and v is not None]
        rank = None if value is None else (
            sum(v < value for v in peers) / (len(peers) - 1) if len(peers) > 1 else 0.0)
        expected.append((str(i), rank))
    found = shares.peer_comparison(share)
    assert rows(found, "brand_code", "peer_percent_rank") == sorted(expected)


def test_many_different_shares_of_one_group_spread(spark):
    """No window holds the group's different shares: the largest is a digit's."""
    share = spark.range(1, 60_001).select(
        F.col("id").cast("string").alias("brand_code"), (F.col("id") % 1).cast("int").alias("category_code"),
        F.concat(F.lit("BSS"), F.col("id") % 1).alias("event_name"),
        (F.col("id") % 1 + 2001).cast("int").alias("event_year"),
        F.concat(F.lit("DEAL"), F.col("id") % 1).alias("period_type"), (F.col("id") / 60_000).alias("new_share"))
    ranks = shares.share_ranks(share, PEERS)
    assert ranks.filter((F.col("below") + 1) / 60_000 != F.col("new_share")).count() == 0
    first = F.floor(F.col("new_share") * shares.DIGITS)
    assert share.groupBy(first).count().agg(F.max("count")).first()[0] <= 16
    text = ranks._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
