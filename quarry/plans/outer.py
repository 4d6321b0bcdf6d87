"""Queries over the outer loop: rounds that are paused, resumed and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import rounds
from quarry.plans.registry import query, table
from quarry.storage import fresh_path

#: Failures of a strategy after which the next round does not use it.
_BAN_AFTER = 20


def _loop(spark: SparkSession, d: str) -> rounds.Loop:
    """Users are seeds; a seed tries its kinds of events from the rarest, without the banned, and fails where one cost over 60."""
    events = table(spark, d, "events").select("user_id", "event_type", "value")
    tried = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    seeds = events.select("user_id").distinct().select(F.col("user_id").alias("seed"), (F.col("user_id") % 3).cast("int").alias("round"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("cell"))

    def generate(own: DataFrame, menus: DataFrame) -> DataFrame:
        open_ = tried.join(menus.select("event_type"), "event_type", "left_anti")
        first = open_.groupBy(F.col("user_id").alias("seed")).agg(F.min(F.struct("n", "event_type", "most")).alias("t"))
        told = own.select("seed").join(first, "seed", "left")
        status = F.when(F.col("t").isNull(), "ERROR").when(F.col("t.most") > 60, "FAILED_FOUND").otherwise("EXHAUSTED")
        return told.select("seed", F.col("t.event_type").alias("strategy"), status.alias("status"), (F.coalesce("t.n", F.lit(0)) * 0.01).alias("cost_usd"))

    def feedback(attempts: DataFrame) -> DataFrame:
        used = attempts.filter("strategy IS NOT NULL").groupBy(F.col("strategy").alias("event_type"))
        return used.agg(F.count_if(F.col("status") == "FAILED_FOUND").alias("failed")).withColumn("cost_usd", F.lit(0.5))

    def menus(told: DataFrame | None) -> DataFrame:
        if told is None:
            return spark.createDataFrame([], "event_type string, failed bigint")
        return told.filter(F.col("failed") > _BAN_AFTER).select("event_type", "failed")

    return rounds.Loop(seeds, generate, feedback, menus)


_ROUND = """r{k} AS (SELECT seed, coalesce(s.strategy, NULL) AS strategy, CASE WHEN s.strategy IS NULL THEN 'ERROR' WHEN most > 60 THEN 'FAILED_FOUND' ELSE 'EXHAUSTED' END AS status, coalesce(n, 0) / 100 AS cost_usd, {k} AS round
 FROM (SELECT DISTINCT user_id AS seed FROM events WHERE user_id % 3 = {k}) u LEFT JOIN (SELECT user_id, arg_min(event_type, (n, event_type)) AS strategy, arg_min(n, (n, event_type)) AS n, arg_min(most, (n, event_type)) AS most
 FROM t WHERE event_type NOT IN (SELECT event_type FROM b{k}) GROUP BY user_id) s ON s.user_id = u.seed)"""
_BANS = "b{k} AS (SELECT strategy AS event_type FROM ({all}) WHERE strategy IS NOT NULL GROUP BY strategy HAVING count(CASE WHEN status = 'FAILED_FOUND' THEN 1 END) > 20)"
_LOOP = ",\n".join(
    [
        "t AS (SELECT user_id, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY user_id, event_type), b0 AS (SELECT NULL::VARCHAR AS event_type WHERE false)",
        _ROUND.format(k=0), _BANS.format(k=1, all="SELECT * FROM r0"), _ROUND.format(k=1), _BANS.format(k=2, all="SELECT * FROM r0 UNION ALL SELECT * FROM r1"), _ROUND.format(k=2),
        "a AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)",
    ]
)


def _run(spark: SparkSession, d: str) -> rounds.RoundLog:
    log = rounds.RoundLog(spark, fresh_path(spark, "loop"))
    # Paused after each round that makes something, and gone on with until the last.
    while rounds.run_rounds(log, _loop(spark, d), stop_after=1).ended != "finished":
        pass
    return log


@query(f"WITH {_LOOP} SELECT seed, round, CASE WHEN seed % 2 = 0 THEN 'even' ELSE 'odd' END AS cell, strategy, status, round(cost_usd, 4) AS cost_usd FROM a")
def loop_attempts(spark: SparkSession, d: str) -> DataFrame:
    """What each seed tried in a loop of three rounds, paused after each."""
    made = _run(spark, d).read(f"{rounds.GENERATION}-*")
    return made.select("seed", "round", "cell", "strategy", "status", F.round("cost_usd", 4).alias("cost_usd"))


@query(f"""WITH {_LOOP}, m AS (SELECT round, count(*) AS seeds, count(CASE WHEN status = 'FAILED_FOUND' THEN 1 END) AS failed_found, count(CASE WHEN status = 'ERROR' THEN 1 END) AS errors, round(sum(cost_usd), 4) AS generation_usd FROM a GROUP BY round)
SELECT m.*, CASE round WHEN 2 THEN 0 ELSE (SELECT count(DISTINCT strategy) FROM a WHERE a.round <= m.round AND strategy IS NOT NULL) END / 2 AS feedback_usd FROM m""")
def loop_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The rounds of that loop summed up from what its runs have finished."""
    return rounds.manifest(_run(spark, d)).withColumn("generation_usd", F.round("generation_usd", 4))
