"""Keyed upserts and replacements as anti-joins: nothing is updated in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def removed(indexed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are indexed but no longer found."""
    return indexed.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def replaced(old: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``old`` without the rows of ``keys``, and ``new``; columns missing on a side are null."""
    return old.join(keys.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upserted(old: DataFrame, new: DataFrame, key: str = "id", order: str = "ordinal") -> DataFrame:
    """``old`` with the rows of ``new`` put in by key, the last of equal keys winning."""
    fresh = last_wins(new, [key], [order]).drop(order)
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
