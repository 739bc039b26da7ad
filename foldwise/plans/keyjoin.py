"""Joins on group keys in which NULL is a key like any other, as it is for groupBy and windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FEW_KEYS = 100_000  # a name and a few numbers each


def beside(keyed: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A hint for tables of at most one row per row of ``keyed``: broadcast if these are counted to be few, nothing else.

    Adaptive execution keeps a sort-merge join where the small side has few keys, and then all rows of a key meet in one task.
    """
    few = not keyed.isStreaming and keyed.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    return F.broadcast if few else lambda table: table


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on equal keys, NULL equal to NULL; the keys come out once."""
    names = {k: f"_right_{k}" for k in keys}
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()], F.lit(True))
    joined = left.join(right.withColumnsRenamed(names), on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())
