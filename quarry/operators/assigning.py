"""Strategies assigned to seed clusters and new ones: by vectors in one ordered stream, or by replayed answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import norm, strip

#: Bytes of seed vectors that every task may hold.
SEED_BYTES = 64 << 20
#: Labels of strategies without a usable answer.
UNNAMED, UNASSIGNED = "unclassified", "unclassified (model gave no assignment)"


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their length, which counts as 1e-12 at least."""
    return rows / np.clip(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12, None)


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return unit_rows(flat.reshape(len(vectors), -1)) if len(vectors) else np.empty((0, 0))


def _seed_matrix(seeds: DataFrame, order: str, vector: str) -> np.ndarray:
    size = seeds.agg(F.sum(F.size(vector)) * 8).first()[0] or 0
    if size > SEED_BYTES:
        raise ValueError(f"seed vectors of {size} bytes, over {SEED_BYTES} (SEED_BYTES)")
    return unit_rows(np.array([r[0] for r in seeds.orderBy(order).select(vector).collect()], dtype=np.float64))


def nearest_seeds(vectors: DataFrame, seeds: DataFrame, order: str, vector: str) -> DataFrame:
    """`vectors` (order, vector) with `nearest_seed_dist`, the cosine distance to the nearest of the seeds; in parallel, one pass."""
    centres = _seed_matrix(seeds, order, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = (1.0 - _matrix(batch.column(1)) @ centres.T).min(axis=1) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(distance)], [order, vector, "nearest_seed_dist"])

    fields = vectors.select(order, vector)
    return fields.mapInArrow(run, fields.schema.simpleString()[7:-1] + ",nearest_seed_dist:double")


def online_assignment(vectors: DataFrame, seeds: DataFrame, order: str, vector: str, threshold: float) -> DataFrame:
    """(order, cluster, is_seed, nearest_seed_dist): each vector in `order` goes to the nearest centre, or founds a cluster beyond `threshold`.

    Seeds keep their centres and come first, numbered from 0 in `order`; a new cluster's centre
    is the direction of the sum of its members so far.  What a vector meets depends on all
    before it, so one task reads the sorted vectors as a stream and holds the centres alone;
    the distances to seeds are worked out in parallel before it.  Null vectors, or such of
    another length, are not allowed.
    """
    centres = _seed_matrix(seeds, order, vector)
    stream = nearest_seeds(vectors, seeds, order, vector).repartition(1).sortWithinPartitions(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((max(16, 2 * len(centres)), centres.shape[1]))
        held[: len(centres)] = centres
        n, sums = len(centres), {}
        for batch in batches:
            found = []
            for row in _matrix(batch.column(1)):
                distance = 1.0 - held[:n] @ row
                j = int(distance.argmin())
                if distance[j] > threshold:
                    j = n
                    if n == len(held):
                        held = np.concatenate([held, np.empty_like(held)])
                    held[j], sums[j], n = row, row.copy(), n + 1
                elif j in sums:
                    sums[j] += row
                    held[j] = sums[j] / np.linalg.norm(sums[j])
                found.append(j)
            clusters = np.array(found, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clusters), pa.array(clusters < len(centres)), batch.column(2)], [order, "cluster", "is_seed", "nearest_seed_dist"])

    kind = vectors.schema[order].dataType.simpleString()
    return stream.mapInArrow(run, f"{order} {kind}, cluster int, is_seed boolean, nearest_seed_dist double")


def named_assignment(strategies: DataFrame, answers: DataFrame, n_seeds: int, merged: DataFrame | None = None) -> DataFrame:
    """(ord, cluster_idx, is_seed, label) of strategies (ord) by replayed answers (ord, place, cluster).

    `seed:N` is a seed by its number, kept within the seeds; any other answer names a new
    cluster, the part behind a colon if there is one.  New clusters are numbered behind the
    seeds by their first mention, names alike in any case being one; what no answer assigns
    goes to one last cluster.  Of several answers to a strategy the last, by place, counts.
    `merged` (name, canonical) joins new clusters under a canonical name; a name it leaves out stays.
    """
    text = strip(F.col("cluster"))
    number = F.coalesce(F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).cast("int"), F.lit(1)) - 1
    is_seed = F.startswith(F.lower(text), F.lit("seed:"))
    name = F.when(F.instr(text, ":") > 0, strip(F.regexp_replace(text, r"(?s)^[^:]*:", ""))).otherwise(text)
    read = answers.filter("ord IS NOT NULL AND cluster IS NOT NULL").select("ord", "place", F.when(is_seed, F.least(F.greatest(number, F.lit(0)), F.lit(n_seeds - 1))).alias("seed"), F.when(~is_seed, name).alias("name"))
    known = read.join(strategies.select("ord").distinct(), "ord", "left_semi").withColumn("key", F.when(F.col("name").isNotNull(), F.coalesce(F.nullif(norm(F.col("name")), F.lit("")), F.lit(UNNAMED))))
    first = known.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("place", "name")).alias("f")).select("key", F.col("f.place").alias("first"), F.coalesce(F.nullif("f.name", F.lit("")), F.lit(UNNAMED)).alias("label"))
    last = known.groupBy("ord").agg(F.max_by(F.struct("seed", "key"), "place").alias("a"))
    given = strategies.select("ord").join(last, "ord", "left")
    lost = F.lit(norm_text(UNASSIGNED))
    keyed = given.select("ord", "a.seed", F.when(F.col("a").isNull(), lost).otherwise(F.col("a.key")).alias("key"))
    missing = keyed.filter(F.col("key") == lost).limit(1).select("key", F.lit(None).cast(answers.schema["place"].dataType).alias("first"), F.lit(UNASSIGNED).alias("label"))
    names = first.unionByName(missing.join(first, "key", "left_anti"))
    if merged is not None:
        canonical = merged.select(norm(F.col("name")).alias("key"), F.col("canonical")).dropDuplicates(["key"])
        names = names.join(canonical, "key", "left").withColumn("label", F.coalesce("canonical", "label")).drop("canonical")
        one = Window.partitionBy("label")
        names = names.withColumn("first", F.min("first").over(one))
    # One row a new cluster: what a menu can hold.
    numbered = names.withColumn("cluster_idx", F.dense_rank().over(Window.orderBy(F.col("first").asc_nulls_last(), F.col("label") if merged is not None else F.col("key"))) + n_seeds - 1)
    joined = keyed.join(numbered.select("key", "cluster_idx", "label"), "key", "left")
    return joined.select("ord", F.coalesce("seed", "cluster_idx").cast("int").alias("cluster_idx"), F.col("seed").isNotNull().alias("is_seed"), F.when(F.col("seed").isNull(), F.col("label")).alias("label"))


def norm_text(text: str) -> str:
    """`scalar.norm` of a constant."""
    return " ".join(text.lower().split())


def batches(strategies: DataFrame, size: int = 25) -> DataFrame:
    """(batch, prompt): the strategies in blocks of `size` by their position (ord from 0), a line each."""
    line = F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("] "), F.col("strategy"))
    grouped = strategies.groupBy(F.floor(F.col("ord") / size).cast("bigint").alias("batch"))
    return grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))
