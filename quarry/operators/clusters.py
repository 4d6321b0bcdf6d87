"""Strategy clusters: statistics, rankings, quotas, weighted menus, example pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import smoothed_weight, unit_hash


def nodes(examples: DataFrame, spine: DataFrame, cluster: str, failed: str) -> DataFrame:
    """Size, failures and failure rate of every cluster of `spine`, empty ones included (rate 0); null is a cluster."""
    facts = examples.groupBy(F.col(cluster).alias("__c")).agg(
        F.count(F.lit(1)).alias("num_questions"), F.count_if(F.col(failed)).alias("num_failed")
    )
    joined = spine.select(cluster).join(facts, F.col(cluster).eqNullSafe(F.col("__c")), "left").drop("__c").na.fill(0, ["num_questions", "num_failed"])
    rate = F.when(F.col("num_questions") > 0, F.col("num_failed") / F.col("num_questions")).otherwise(0.0)
    return joined.withColumn("failure_rate", rate)


#: Sort keys of each ranking, all descending; the cluster's own order breaks ties.
RANKINGS: dict[str, list[Column | str]] = {
    "underrepresented": ["score", "failure_rate", "-share"],
    "failure_rate": ["failure_rate", "-share", "num_failed"],
    "volume": ["num_failed", "failure_rate"],
}


def rank(node: DataFrame, cluster: str, by: str = "underrepresented") -> DataFrame:
    """Share, score, draw weight and rank (from 1) of cluster nodes; nodes are few, one per cluster."""
    total = node.agg(F.sum("num_questions").alias("total"))
    scored = node.join(F.broadcast(total)).withColumn(
        "share", F.when(F.col("total") > 0, F.col("num_questions") / F.col("total")).otherwise(0.0)
    )
    scored = scored.withColumn("score", F.when(F.col("num_questions") > 0, F.col("failure_rate") * (1 - F.col("share"))).otherwise(0.0))
    scored = scored.withColumn("weight", smoothed_weight(F.col("num_failed"), F.col("num_questions"), F.col("total")))
    keys = [(-F.col(k[1:]) if k.startswith("-") else F.col(k)).desc() for k in RANKINGS[by]]
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*keys, F.col(cluster).asc()))).drop("total")


def run_breakdown(examples: DataFrame, cluster: str, run: str, failed: str) -> DataFrame:
    """Size and failures per cluster and source run; a null or empty run is 'unknown'."""
    label = F.coalesce(F.nullif(F.col(run), F.lit("")), F.lit("unknown"))
    return examples.groupBy(F.col(cluster), label.alias("source_run")).agg(
        F.count(F.lit(1)).alias("num_questions"), F.count_if(F.col(failed)).alias("num_failed")
    )


def over_quota(node: DataFrame, ban_after: int) -> DataFrame:
    """Clusters with more failures than `ban_after`: their strategies are banned from the next menu."""
    return node.filter(F.col("num_failed") > ban_after)


def first_failures(examples: DataFrame, cluster: str, order: str, failed: str, n: int) -> DataFrame:
    """The first n failures of each cluster, with their place; limited inside each task first."""
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(order))
    return examples.filter(F.col(failed)).withColumn("place", place).filter(F.col("place") <= n)


def round_robin(rows: DataFrame, bucket: str, place: str, n: int) -> DataFrame:
    """n rows taken in turns over the buckets."""
    return rows.orderBy(place, bucket).limit(n)


def weighted_menus(seeds: DataFrame, pool: DataFrame, seed: str, item: str, weight: str, k: int, salt: str) -> DataFrame:
    """k items of a small pool for each seed, drawn without replacement by weight (key u^(1/w))."""
    u = unit_hash(salt, F.concat_ws("|", F.col(seed).cast("string"), F.col(item)))
    drawn = seeds.join(F.broadcast(pool)).withColumn("key", F.ln(u) / F.col(weight))
    order = Window.partitionBy(seed).orderBy(F.col("key").desc(), F.col(item))
    return drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def allocate(strata: DataFrame, stratum: str, size: str, n: int) -> DataFrame:
    """Largest-remainder allocation of n over strata in proportion to size; ties by stratum."""
    total = strata.agg(F.sum(size).alias("total"))
    exact = strata.join(F.broadcast(total)).withColumn("exact", F.lit(n) * F.col(size) / F.col("total"))
    exact = exact.withColumn("base", F.floor("exact"))
    left = F.lit(n) - F.sum("base").over(Window.partitionBy())
    order = F.row_number().over(Window.orderBy((F.col("exact") - F.col("base")).desc(), F.col(stratum)))
    return exact.select(stratum, size, (F.col("base") + (order <= left).cast("int")).cast("bigint").alias("allocated"))


def stratified_sample(rows: DataFrame, allocation: DataFrame, stratum: str, key: str, salt: str) -> DataFrame:
    """The allocated number of rows of each stratum, those with the smallest keyed hash; null is a stratum.

    No stratum gives more than the largest allocation, so each task keeps as many of one before any is moved.
    """
    most = allocation.agg(F.max("allocated")).first()[0] or 0
    order = Window.partitionBy(stratum).orderBy(unit_hash(salt, F.col(key)), key)
    placed = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.lit(int(most)))
    wanted = allocation.select(F.col(stratum).alias("__s"), F.col("allocated").alias("__n"))
    return placed.join(wanted, F.col(stratum).eqNullSafe(F.col("__s"))).filter("place <= __n").drop("__s", "__n")
