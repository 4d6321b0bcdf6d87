"""References found in answer traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import truthy


def positional_sources(calls: DataFrame, documents: str, data: str) -> DataFrame:
    """One row per document of each call, with the raw record at the same place or null.

    Columns are the call's others, `place`, `document` and `raw`.  Records beyond the last
    document are left out; a call with null or no documents gives no row.
    """
    rest = [c for c in calls.columns if c not in (documents, data)]
    placed = calls.select(*rest, data, F.posexplode(documents).alias("place", "document"))
    return placed.withColumn("raw", F.try_element_at(data, F.col("place") + 1)).select(*rest, "place", "document", "raw")


def selected_refs(refs: DataFrame, answer: str, order: str, url: str, title: str, backref: str) -> DataFrame:
    """One reference of each answer and url (title where the url is null or empty), with its `position`.

    The first one back-referred to wins, or else the first; `position` is that of the first
    of any kind.  A null `backref` counts as false.
    """
    rest = [c for c in refs.columns if c != answer]
    key = F.coalesce(truthy(F.col(url)), F.col(title)).alias("__key")
    rank = F.struct(~F.coalesce(F.col(backref), F.lit(False)), F.col(order))
    won = refs.groupBy(answer, key).agg(F.min(order).alias("position"), F.min_by(F.struct(*rest), rank).alias("__won"))
    return won.select("position", answer, *[F.col(f"__won.{c}").alias(c) for c in rest if c != "position"])
