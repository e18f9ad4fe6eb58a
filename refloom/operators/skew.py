"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot if it has so many rows at least and is among the MAX_HOT largest.
HOT_ROWS = 20_000
MAX_HOT = 1000


def hot_keys(groups: DataFrame, key: str, count: str = "n", hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> list:
    """The keys to treat apart. A key that isn't named has fewer than ``hot_rows`` rows or than a ``max_hot``-th of all."""
    return [r[0] for r in groups.where(F.col(count) >= hot_rows).orderBy(F.desc(count)).limit(max_hot).select(key).collect()]


def join_even(rows: DataFrame, groups: DataFrame, key: str, count: str = "n", how: str = "inner", hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """``rows`` joined with ``groups``, one row for each ``key``, whose ``count`` column says how many rows a key has.

    Groups of hot keys, ``max_hot`` at most, are broadcast and their rows stay
    where they are; the others meet in a join in which no key is hot.
    """
    hot = hot_keys(groups, key, count, hot_rows, max_hot)
    payload = groups.drop(count)
    if not hot:
        return rows.join(payload, key, how)
    named = F.broadcast(groups.sparkSession.createDataFrame([(k,) for k in hot], T.StructType([groups.schema[key]])))
    cold = rows.join(named, key, "left_anti").join(payload.join(named, key, "left_anti"), key, how)
    return cold.unionByName(rows.join(named, key, "left_semi").join(F.broadcast(payload.join(named, key, "left_semi")), key, how))
