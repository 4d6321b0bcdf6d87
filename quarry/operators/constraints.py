"""Checks on tables: row rules observed while the rows are used, and rules on keys and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.operators.positions import numbered


class BrokenRule(ValueError):
    """Rows that break a rule, named by their keys."""


class Watch:
    """Rules that every row must keep, looked at in the same pass that writes or counts the rows.

    Pass the rows on through `rows`, run the job that uses them, then call `enforce`: it adds
    no job of its own.  A rule that is null for a row is broken.
    """

    def __init__(self, rows: DataFrame, key: str, rules: dict[str, Column]) -> None:
        self._seen, self._rules = Observation(), list(rules)
        told = []
        for i, rule in enumerate(rules.values()):
            broken = ~F.coalesce(rule, F.lit(False))
            name = F.when(broken, F.col(key).cast("string"))
            told += [F.count_if(broken).alias(f"n{i}"), F.min(name).alias(f"min{i}"), F.max(name).alias(f"max{i}")]
        self.rows = rows.observe(self._seen, *told)

    def broken(self) -> dict[str, tuple[int, str, str]]:
        """How many rows broke each broken rule, with the least and the greatest of their keys."""
        told = self._seen.get
        return {name: (told[f"n{i}"], told[f"min{i}"], told[f"max{i}"]) for i, name in enumerate(self._rules) if told[f"n{i}"]}

    def enforce(self) -> None:
        found = self.broken()
        if found:
            raise BrokenRule("; ".join(f"{name}: {n} rows, {low} to {high}" for name, (n, low, high) in found.items()))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that more than one row has; null is a key like any other."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def shared(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """(key) that both tables hold, each once: empty where they are disjoint.  Null keys are not compared."""
    one, other = (t.select(key.alias("key")).distinct() for t in (left, right))
    return one.join(other, "key", "left_semi")


def missing(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key) that are wanted and that `rows` does not hold."""
    return wanted.select(key).distinct().join(rows.select(key), key, "left_anti")


def require_none(found: DataFrame, rule: str, shown: int = 5) -> None:
    """Fail with some of the rows if there are any."""
    some = found.limit(shown).collect()
    if some:
        raise BrokenRule(f"{rule}: {', '.join(str(tuple(r)) for r in some)}")


def restricted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted; a wanted key without a row is an error."""
    require_none(missing(wanted, rows, key), f"{key} without a row")
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def misaligned(left: DataFrame, right: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """(position, left, right) where two tables, each in `order`, differ at a position; a side that is shorter is null there.

    Positions are found range by range, so they do not depend on how the tables are partitioned.
    """
    value = F.struct(*columns)
    one, other = (numbered(t.select(*order, *[c for c in columns if c not in order]), order, "position").select("position", value.alias(side)) for t, side in ((left, "left"), (right, "right")))
    return one.join(other, "position", "full").filter(~F.col("left").eqNullSafe(F.col("right")))


def first_passing(rows: DataFrame, order: str, keep: Column, start: int, n: int, key: str) -> DataFrame:
    """(order, key) at places start to start + n - 1 of the rows that pass `keep`, the first of each `key`, in `order`.

    Only a prefix of `order`, an integer column, is read: its bound doubles until it holds enough, so
    files and row groups behind it are skipped by their statistics.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return rows.select(order, key).limit(0)
    width = max(1, start + n)
    while True:
        part = rows.filter(F.col(order) < F.lit(low + width)).filter(keep & F.col(key).isNotNull())
        first = part.groupBy(key).agg(F.min(order).alias(order))
        if low + width > high or first.count() >= start + n:
            break
        width *= 4
    found = first.orderBy(order).offset(start).limit(n)
    return found.select(order, key)
