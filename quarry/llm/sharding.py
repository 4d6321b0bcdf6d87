"""Sharding by sampled splitters, in DataFrame functions only.

Rows are range-partitioned by (hash of the group, id): a size-weighted sample of keys gives
splitters at its quantiles, the ranges between them are weighed exactly, and overfull
ranges are sampled again and subdivided.  The exact weights before each range and the sums
inside it place every row, so shards differ by a row at most, and no group, however large,
is more than its ranges can hold: the id takes part in the key, so any range can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.storage import materialize

#: Ranges aimed at for each shard, and sampled keys for each range.
RANGES_PER_SHARD = 16
SAMPLE_PER_RANGE = 12
#: A range over this many times its fair weight is subdivided.
OVERFULL = 4.0
OVERHEAD = 16


def _hex(x: Column) -> Column:
    """A signed 64-bit number as 16 hex digits that sort like it."""
    return F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at or below `key`, by binary search in an array literal."""
    if not splitters:
        return F.lit(0)
    table = F.split(F.lit(",".join(splitters)), ",")
    top = 1 << (len(splitters).bit_length() - 1)
    steps = F.array(*[F.lit(top >> i) for i in range(top.bit_length())])

    def step(at: Column, by: Column) -> Column:
        there = at + by
        return F.when((there <= len(splitters)) & (F.get(table, there - 1) <= key), there).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _sample(rows: DataFrame, weight: float, expected: int, salt: int) -> list[str]:
    """Keys drawn with chances in proportion to size; about `expected`, so bounded."""
    u = F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    return sorted(r["key"] for r in rows.filter(u < F.col("size") * (expected / weight)).select("key").collect())


def _quantiles(keys: list[str], ranges: int) -> list[str]:
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _weigh(rows: DataFrame, splitters: list[str]) -> list:
    return (
        rows.groupBy(range_of(F.col("key"), splitters).alias("range"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
        .orderBy("range")
        .collect()
    )


def splitters_for(rows: DataFrame, n_ranges: int, total: float) -> tuple[list[str], list]:
    """Splitters of `rows(key, size)` and the exact weight of every range that has rows.

    The driver holds keys and range weights only, their number set by `n_ranges`.
    """
    keys = _sample(rows, total, n_ranges * SAMPLE_PER_RANGE, 0)
    splitters, most = _quantiles(keys, n_ranges), OVERFULL * total / n_ranges
    salt = 0
    while True:
        weights = _weigh(rows, splitters)
        full = [w for w in weights if w["bytes"] > most and w["n"] > 1]
        if not full:
            return splitters, weights
        salt += 1
        weight = float(sum(w["bytes"] for w in full))
        wanted = max(2 * len(full), int(4 * weight / most))
        inside = rows.filter(range_of(F.col("key"), splitters).isin([w["range"] for w in full]))
        more = _sample(inside, weight, wanted * SAMPLE_PER_RANGE, salt)
        before = len(splitters)
        splitters = sorted({*splitters, *_quantiles(more, wanted)})
        if len(splitters) == before:
            return splitters, weights


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def assign_shards(
    docs: DataFrame,
    n_shards: int = 40,
    law: str = "bytes",
    ranges_per_shard: int = RANGES_PER_SHARD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of `docs`.

    Law "bytes": shards have near equal sums of size; "rows": counts at most one apart.
    `size` is the text's UTF-8 bytes plus 16, a null text having none.  Rows of equal text
    are next to each other and share a shard unless a shard's end falls among them.  Slots
    number a shard's rows from 0 without gaps, in key order.  Null ids order first; repeated
    rows get slots of their own; an empty table gives an empty result.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("bytes"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    ).withColumn("row", F.monotonically_increasing_id())
    # The row number tells repeated rows apart; written once, it does not change any more.
    rows = materialize(
        narrow.select(
            "doc_id",
            "bytes",
            "text_crc32",
            (F.col("bytes") if law == "bytes" else F.lit(1).cast("bigint")).alias("size"),
            F.concat(
                _hex(F.col("hash")),
                _hex(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))),
                _hex(F.col("row")),
            ).alias("key"),
        ),
        "shard-rows",
    )
    total = float(rows.agg(F.sum("size")).first()[0] or 0)
    splitters, weights = splitters_for(rows, n_shards * ranges_per_shard, max(total, 1.0))
    bases, n, weight = [], 0, 0
    for w in weights:
        bases.append((w["range"], n, weight))
        n, weight = n + w["n"], weight + w["bytes"]
    base = _table(spark, bases, "range int, rows_before bigint, size_before bigint")
    order = Window.partitionBy("range").orderBy("key")
    ranged = rows.withColumn("range", range_of(F.col("key"), splitters)).join(base, "range")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    middle = F.col("size_before") + F.coalesce(before, F.lit(0)) + (F.col("size") / 2 if law == "bytes" else F.lit(0.5))
    placed = materialize(
        ranged.select(
            "doc_id",
            "bytes",
            "text_crc32",
            F.least(F.floor(middle * (n_shards / max(total, 1.0))), F.lit(n_shards - 1)).cast("int").alias("shard"),
            (F.col("rows_before") + F.row_number().over(order) - 1).alias("position"),
        ),
        "shard-placed",
    )
    firsts = [(r["shard"], r["first"]) for r in placed.groupBy("shard").agg(F.min("position").alias("first")).collect()]
    return placed.join(_table(spark, firsts, "shard int, first bigint"), "shard").select(
        "doc_id",
        F.col("bytes").alias("size"),
        "text_crc32",
        "shard",
        (F.col("position") - F.col("first")).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, law: str = "bytes", id_col: str = "doc_id") -> DataFrame:
    """Write `docs` (unique ids) as a Parquet folder per shard below `path`; returns the assignment."""
    name = "__quarry_shard"
    assigned = materialize(assign_shards(docs, n_shards, law, id_col=id_col), "shards")
    keyed = docs.join(assigned.select(F.col("doc_id").alias(id_col), F.col("shard").alias(name)), id_col)
    keyed.write.partitionBy(name).parquet(path)
    return assigned
