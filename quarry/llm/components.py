"""Connected components of an undirected graph given as an edge table.

Alternating large-star and small-star steps (Kiveris et al., 2014) expressed as joins and
aggregates.  No neighbourhood is ever collected: a node's smallest neighbour is a partial
aggregate, and the join that spreads it is one that AQE can split when a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.storage import materialize


def _is_stars(edges: DataFrame) -> bool:
    """Every edge (u, v) leads from a node of one edge to its root: no u has two edges, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.filter("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Self loops, repeated edges and either direction are accepted; edges with a null end are
    ignored.  An empty edge table gives an empty result.
    """
    pairs = edges.select(
        F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")
    ).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    current = materialize(pairs.distinct(), "edges")
    while not _is_stars(current):
        # The large step gives a row per edge at most, so repeated rows can wait for the one exchange at the end.
        current = materialize(_small_star(_large_star(current)).distinct(), "edges")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
