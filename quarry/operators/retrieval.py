"""Passages to papers, candidate pools, and signals over papers and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import cosine_distance
from quarry.operators.assigning import SEED_BYTES, _matrix

#: Vectors that meet all centroids of their group at once.
BLOCK = 256
#: How far a product in single precision may lie from the exact one; at length 1 it is off by 1e-6.
SLACK = 1e-4


def papers(passages: DataFrame, metadata: DataFrame, key: str, meta_key: str, score: str, order: str, n: int) -> DataFrame:
    """Best score, number of passages and first passage of each paper with metadata; the n best."""
    grouped = passages.groupBy(key).agg(
        F.max(score).alias("best_score"), F.count(F.lit(1)).alias("n_passages"), F.min(order).alias("first_passage")
    )
    known = grouped.join(metadata.select(F.col(meta_key).alias(key)), key, "left_semi")
    return known.orderBy(F.col("best_score").desc(), F.col("first_passage"), F.col(key)).limit(n)


def fresh_by_query(hits: DataFrame, base: DataFrame, key: str, query: str) -> DataFrame:
    """Hits of keys not in `base`, each key kept in the first query that found it, all its rows there."""
    first = hits.groupBy(key).agg(F.min(query).alias("__first"))
    fresh = hits.join(base.select(key).distinct(), key, "left_anti").join(first, key)
    return fresh.filter(F.col(query) == F.col("__first")).drop("__first")


def nearest_seed(vectors: DataFrame, seeds: DataFrame, vec_id: str, embedding: str, seed_id: str) -> DataFrame:
    """The nearest of a few seed vectors and its cosine distance; ties to the smallest seed.

    The seeds, of SEED_BYTES at most, are one array that every row meets, so nothing is shuffled.
    """
    size = seeds.agg(F.sum(F.size(embedding)) * 8).first()[0] or 0
    if size > SEED_BYTES:
        raise ValueError(f"seed vectors of {size} bytes, over {SEED_BYTES} (SEED_BYTES)")
    held = seeds.agg(F.collect_list(F.struct(F.col(seed_id).alias("seed"), F.col(embedding).alias("vector"))).alias("__seeds"))
    distances = F.transform("__seeds", lambda s: F.struct(cosine_distance(F.col(embedding), s["vector"]).alias("distance"), s["seed"].alias("seed")))
    best = vectors.select(vec_id, embedding).crossJoin(F.broadcast(held)).select(vec_id, F.array_min(distances).alias("s"))
    return best.filter("s IS NOT NULL").select(vec_id, F.col("s.seed").alias("seed"), F.col("s.distance").alias("distance"))


class Centres:
    """The centroids of one group, met by its vectors in order.

    A block of vectors is multiplied with all centroids at once, in single precision; a
    centroid that is moved or founded within the block is multiplied with the block's other
    vectors again.  These products only propose: what lies within SLACK of the nearest, or of
    the threshold, is decided by distances in double precision.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold, self.n = threshold, 0
        self.sums, self.units = np.empty((0, 0)), np.empty((0, 0), np.float32)

    def _room(self, more: int, width: int) -> None:
        if self.n + more > len(self.sums):
            size = max(2 * len(self.sums), self.n + more)
            for name in ("sums", "units"):
                old = getattr(self, name)
                held = np.empty((size, width), old.dtype)
                held[: len(old)] = old.reshape(-1, width)
                setattr(self, name, held)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The cluster of each of the `rows`, vectors of length 1."""
        out = np.empty(len(rows), np.int64)
        for at in range(0, len(rows), BLOCK):
            block = rows[at : at + BLOCK]
            self._room(len(block), block.shape[1])
            light, known = block.astype(np.float32), self.n
            near = np.empty((len(block), known + len(block)), np.float32)
            near[:, :known] = light @ self.units[:known].T
            for i, x in enumerate(block):
                out[at + i] = j = self._place(x, near[i, : self.n])
                near[i + 1 :, j] = light[i + 1 :] @ self.units[j]
        return out

    def _place(self, x: np.ndarray, near: np.ndarray) -> int:
        best = near.max(initial=-np.inf)
        if 1 - best <= self.threshold + SLACK:
            close = np.flatnonzero(near >= best - SLACK)
            sums = self.sums[close]
            distance = 1 - (sums * x).sum(axis=1) / np.maximum(np.sqrt((sums * sums).sum(axis=1)), 1e-12)
            k = int(distance.argmin())
            if distance[k] <= self.threshold:
                j = int(close[k])
                self.sums[j] += x
                self.units[j] = self.sums[j] / max(np.linalg.norm(self.sums[j]), 1e-12)
                return j
        self.sums[self.n] = self.units[self.n] = x
        self.n += 1
        return self.n - 1


def online_clusters(vectors: DataFrame, group: str, order: str, embedding: str, threshold: float) -> DataFrame:
    """Sequential nearest-centroid assignment within each group: (group, order, cluster).

    A vector joins the nearest centroid within `threshold` (the first of equals), whose mean
    it moves, or else opens a cluster.  The rule depends on the order of all earlier vectors
    of the group, so a group is one task's work by definition: choose groups accordingly.  The
    task reads its group as a stream and holds the centroids alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centres = None, Centres(threshold)
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, rows = pc.run_end_encode(batch.column(0)), _matrix(batch.column(2))
            found, start = [], 0
            for name, end in zip(runs.values, runs.run_ends.to_pylist(), strict=True):
                if last is None or not name.equals(last):
                    last, centres = name, Centres(threshold)
                found.append(centres.assign(rows[start:end]))
                start = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found))], [group, order, "cluster"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    # With a number of its own the exchange is not coalesced, which would put small groups into one task.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = vectors.select(group, order, embedding).repartition(tasks, group).sortWithinPartitions(group, order)
    return stream.mapInArrow(run, f"{group} {kinds[group]}, {order} {kinds[order]}, cluster bigint")


def group_normalised(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """(reward - mean) / population standard deviation within the group, by aggregate and join; null is a group."""
    stats = rows.groupBy(F.col(group).alias("__g")).agg(F.avg(reward).alias("__m"), F.stddev_pop(reward).alias("__s"))
    value = F.when(F.col("__s") > 0, (F.col(reward) - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return rows.join(stats, F.col(group).eqNullSafe(F.col("__g"))).withColumn("advantage", value).drop("__g", "__m", "__s")


def attempt_numbers(events: DataFrame, seed: str, order: list[str]) -> DataFrame:
    """Attempts of each seed numbered from 0, the last one marked as deciding."""
    w = Window.partitionBy(seed)
    numbered = events.withColumn("attempt", F.row_number().over(w.orderBy(*order)) - 1)
    return numbered.withColumn("is_last", F.col("attempt") == F.count(F.lit(1)).over(w) - 1)
