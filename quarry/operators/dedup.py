"""First-wins, latest-wins and order-preserving merges.

Each winner is a min or max of a struct in a partial aggregate, so a key that holds many
rows is combined before the shuffle and no window sorts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in `order` (ascending, nulls first); columns of `df`."""
    rest = [c for c in df.columns if c not in keys]
    won = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__won"))
    return won.select(*[F.col(c) if c in keys else F.col(f"__won.{c}").alias(c) for c in df.columns])


def latest_wins(df: DataFrame, keys: list[str], is_error: Column, order: Column) -> DataFrame:
    """The latest row of each key; a success is never replaced by a later error."""
    rest = [c for c in df.columns if c not in keys]
    won = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(~is_error, order)).alias("__won"))
    return won.select(*[F.col(c) if c in keys else F.col(f"__won.{c}").alias(c) for c in df.columns])


def keyed_merge(df: DataFrame, key: str, order: str, version: Column) -> DataFrame:
    """The last version of each key at the position of its first appearance (column `position`)."""
    rest = [c for c in df.columns if c != key]
    won = df.groupBy(key).agg(F.min(order).alias("position"), F.max_by(F.struct(*rest), version).alias("__won"))
    return won.select("position", key, *[F.col(f"__won.{c}").alias(c) for c in rest if c != "position"])


def work_list(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a finished row: what an interrupted run has still to do."""
    return items.join(done.select(key), key, "left_anti")
