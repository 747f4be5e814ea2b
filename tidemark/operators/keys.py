"""Joins on grouping keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match each other, as they do in a grouping."""
    renamed = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    same = (F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys)
    joined = left.join(renamed, reduce(lambda a, b: a & b, same), how)
    return joined.drop(*[f"right_{k}" for k in keys])
