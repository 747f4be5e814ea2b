"""Bounded samples of labelled documents, for the operators that train a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLOTS = 1 << 30


def capped(rows: DataFrame, group: str, keys: list[str], most: int) -> DataFrame:
    """About `most` different rows at most of each group, chosen by a hash of the key columns.

    A group's rows are counted and kept at the rate most / count, so the sample is spread over all
    rows, needs no sort and is the same on every run. Rows that repeat count once in it, however
    many there are. One count per group passes the driver: this is for columns of few values, such as
    labels; `of_every_group` is for columns of any number of values.
    """
    counts = {r[group]: r["count"] for r in rows.groupBy(group).count().collect()}
    rate: Column = F.lit(0)
    for value, n in counts.items():
        share = min(_SLOTS, int(_SLOTS * most / n))
        rate = F.when(F.col(group) == value, F.lit(share)).otherwise(rate)
    chosen = rows.where(F.pmod(F.xxhash64(*keys), F.lit(_SLOTS)) < rate)
    return chosen.dropDuplicates([*keys, group])


def of_every_group(
    rows: DataFrame, group: str, keys: list[str], most: int, most_rows: int, sure: Column
) -> DataFrame:
    """About `most` different rows at most of each group and `most_rows` of all, by a hash as in `capped`.

    No group is left out: with many groups each has fewer rows, and of every group that has rows
    where `sure` holds, the one with the least hash is always chosen. One count per group passes
    the driver.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(_SLOTS))
    sizes = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(sure, slot)).alias("first")).collect()
    most = min(most, max(1, most_rows // max(1, len(sizes))))
    rates = [(r[group], min(_SLOTS, int(_SLOTS * most / r["n"])), r["first"]) for r in sizes]
    rate = rows.sparkSession.createDataFrame(rates, f"{group} string, _rate long, _first long")
    chosen = rows.join(F.broadcast(rate), group).where(
        (slot < F.col("_rate")) | (slot == F.col("_first")))
    return chosen.select(*rows.columns).dropDuplicates([*keys, group])


def with_texts(docs: DataFrame, sample: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The sample's rows with their texts. The sample is bounded, so it may be broadcast.

    There is one row per id: of several texts with one id, the least.
    """
    ids = sample.withColumnRenamed(id_column, "_id")
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    found = texts.join(F.broadcast(ids.select("_id").distinct()), "_id", "left_semi")
    return found.groupBy("_id").agg(F.min("_text").alias("_text")).join(F.broadcast(ids), "_id")
