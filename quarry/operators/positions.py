"""Positions in an order over a whole table, without a task that holds more than a range of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import materialize

#: A row's place inside its partition stands in the lower bits of `monotonically_increasing_id`.
_PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """`rows` with their place from 0 in `order`, nulls first; rows equal in `order` stand in any order.

    Rows go to ranges of `order`, each is sorted by itself, and what comes before a range is
    the sum of the ranges' counts, one row a range.  The result is a written table, so places
    stay as they are.  A column of that name is replaced; an empty table stays empty.
    """
    sorted_ranges = rows.drop(name).repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialize(sorted_ranges.withColumn(name, F.monotonically_increasing_id()), "ranges")
    part = "__part"
    while part in rows.columns:
        part += "_"
    placed = held.withColumn(part, F.shiftright(name, _PLACE_BITS))
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    place = F.col(name).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + F.col("__before")
    # One row for each shuffle partition.
    return placed.join(F.broadcast(before), part).withColumn(name, place).drop(part, "__before")
