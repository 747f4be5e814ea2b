"""Filters of bounded size on keys, applied before the rows are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Slots of the filter. It has at most a 64th as many rows, of two numbers each: 4 MB.
SLOTS = 1 << 24
_WORD_BITS = 64


def _slot(keys, slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots))


def _mask(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (slot % _WORD_BITS).cast("int"))


def key_filter(df: DataFrame, keys, slots: int = SLOTS) -> DataFrame:
    """(word, mask): the slots that the hashes of the keys fall into, as words of 64 bits.

    Rows with a NULL key match nothing in a join and leave no mark. Words are combined before the
    shuffle; there are at most `slots` / 64 of them, whatever the number of keys.
    """
    known = df.dropna(subset=list(keys)).select(_slot(keys, slots).alias("slot"))
    slot = F.col("slot")
    return known.groupBy(F.floor(slot / _WORD_BITS).alias("word")).agg(
        F.bit_or(_mask(slot)).alias("mask"))


def mark_frequent(df: DataFrame, keys, most: int, slots: int = SLOTS) -> DataFrame:
    """(word, mask): the slots of keys with more than `most` rows, as in `key_filter`.

    NULLs are keys like others. Every word that a row falls into is there, with a mask of 0 if
    none of its keys has that many.
    """
    counts = df.groupBy(F.xxhash64(*keys).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    slot = F.pmod("hash", F.lit(slots))
    return counts.groupBy(F.floor(slot / _WORD_BITS).alias("word")).agg(
        F.bit_or(F.when(F.col("n") > most, _mask(slot)).otherwise(0)).alias("mask"))


def keep_marked(df: DataFrame, keys, marks: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows whose keys may be among those of `marks`: all that are, and a few that are not.

    The marks have a proven bound and are broadcast, so rows are dropped where they are read. With
    many more keys than slots the filter lets most rows pass; it never drops one that has a match.
    """
    slot = _slot(keys, slots)
    words = F.broadcast(marks.withColumnsRenamed({"word": "_word", "mask": "_mask"}))
    joined = df.join(words, F.floor(slot / _WORD_BITS) == F.col("_word"))
    return joined.filter(F.col("_mask").bitwiseAND(_mask(slot)) != 0).select(*df.columns)


def drop_marked(df: DataFrame, keys, marks: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows that `keep_marked` does not keep, for marks that have every word of `df`."""
    slot = _slot(keys, slots)
    words = F.broadcast(marks.withColumnsRenamed({"word": "_word", "mask": "_mask"}))
    joined = df.join(words, F.floor(slot / _WORD_BITS) == F.col("_word"))
    return joined.filter(F.col("_mask").bitwiseAND(_mask(slot)) == 0).select(*df.columns)
