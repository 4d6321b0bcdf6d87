"""Rounds of generation and feedback over a log of committed stages.

Each stage's table is written once into a folder of its own and counts when its write has
finished, so a loop that was stopped anywhere goes on from its last finished stage and gives
the same tables.  Only counts, sums and the names of cells reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.storage import finished_folders

GENERATION, FEEDBACK, MENUS = "generation", "feedback", "menus"


class RoundLog:
    """Tables by round and stage in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, number: int | str, stage: str) -> str:
        return f"{self.path}/round={number}/stage={stage}"

    def finished(self, number: int, stage: str) -> bool:
        return bool(finished_folders(self.spark, self._folder(number, stage)))

    def stage(self, number: int, stage: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """A stage's table, made and written unless it is finished, and whether it was made now."""
        fresh = not self.finished(number, stage)
        if fresh:
            make().write.mode("overwrite").parquet(self._folder(number, stage))
        return self.spark.read.parquet(self._folder(number, stage)), fresh

    def read(self, stage: str, upto: int | None = None) -> DataFrame | None:
        """A stage's finished tables of all rounds with their `round`, or of those before `upto`; None if there is none.

        `stage` may be a pattern, as `generation-*` for all cells.  This is also how an index is built anew.
        """
        folders = [f for f in finished_folders(self.spark, self._folder("*", stage)) if upto is None or int(f.split("/round=")[1].split("/")[0]) < upto]
        return self.spark.read.option("basePath", self.path).parquet(*folders).drop("stage") if folders else None


@dataclass(frozen=True)
class Loop:
    """What a loop does: seeds are (seed, round, cell), and every function is from tables to a table.

    `generate(seeds, menus)` gives a row a seed with at least seed, status and cost_usd;
    `feedback(attempts)` looks at all rounds so far and gives rows with a cost_usd; `menus(feedback)`
    makes the next round's menus, from None the first round's.
    """

    seeds: DataFrame
    generate: Callable[[DataFrame, DataFrame], DataFrame]
    feedback: Callable[[DataFrame], DataFrame]
    menus: Callable[[DataFrame | None], DataFrame]


@dataclass(frozen=True)
class Run:
    """How one run of a loop ended: finished, paused or stopped by the budget, at which round, what it made and spent itself."""

    ended: str
    round: int
    fresh_rounds: int
    spent: float


def _spent(made: DataFrame) -> float:
    return made.agg(F.sum("cost_usd")).first()[0] or 0.0


def _complete(seeds: DataFrame, made: DataFrame, number: int, cell: str) -> None:
    """A cell must give exactly its seeds, once each; otherwise the loop stops here."""
    wrong = seeds.groupBy("seed").agg(F.lit(1).alias("asked")).join(made.groupBy("seed").agg(F.count(F.lit(1)).alias("given")), "seed", "full")
    row = wrong.filter("asked IS NULL OR given IS NULL OR given > 1").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("seed").cast("string")).alias("first")).first()
    if row.n:
        raise ValueError(f"round {number}, cell {cell}: {row.n} seeds missing, unasked or repeated, as {row.first}")


def run_rounds(log: RoundLog, loop: Loop, stop_after: int | None = None, budget: float | None = None) -> Run:
    """Run the loop's open stages; with `stop_after` it pauses after so many rounds in which it made something.

    A round read wholly from the log is no such round.  No cell begins once this run has spent
    `budget`, so it is passed by one cell at most; finished feedback is read again and costs
    nothing.  Feedback is left out after the last round.
    """
    cells = [(r["round"], r["cell"]) for r in loop.seeds.select("round", "cell").distinct().orderBy("round", "cell").collect()]
    numbers = sorted({number for number, _ in cells})
    spent, fresh_rounds = 0.0, 0
    for number in numbers:
        before = None if number == numbers[0] else log.read(FEEDBACK, number).filter(F.col("round") == numbers[numbers.index(number) - 1]).drop("round")
        menus, _ = log.stage(number, MENUS, lambda told=before: loop.menus(told))
        fresh_round = False
        for cell in [c for n, c in cells if n == number]:
            if budget is not None and spent >= budget and not log.finished(number, f"{GENERATION}-{cell}"):
                return Run("stopped", number, fresh_rounds, spent)
            seeds = loop.seeds.filter((F.col("round") == number) & F.col("cell").eqNullSafe(cell)).drop("round")

            def make(own: DataFrame = seeds, shown: DataFrame = menus) -> DataFrame:
                return loop.generate(own, shown).withColumn("cell", F.lit(cell))  # noqa: B023 - called before the next cell

            made, fresh = log.stage(number, f"{GENERATION}-{cell}", make)
            if fresh:
                _complete(seeds, made, number, cell)
                spent, fresh_round = spent + _spent(made), True
        fresh_rounds += fresh_round
        if number != numbers[-1]:
            told, fresh = log.stage(number, FEEDBACK, lambda upto=number: loop.feedback(log.read(f"{GENERATION}-*", upto + 1)))
            spent += _spent(told) if fresh else 0.0
            if stop_after is not None and fresh_rounds >= stop_after:
                return Run("paused", number, fresh_rounds, spent)
    return Run("finished", numbers[-1] if numbers else -1, fresh_rounds, spent)


def manifest(log: RoundLog) -> DataFrame:
    """(round, seeds, failed_found, errors, generation_usd, feedback_usd) of what is finished, over all runs of the loop."""
    made = log.read(f"{GENERATION}-*")
    rows = made.groupBy("round").agg(
        F.count(F.lit(1)).alias("seeds"), F.count_if(F.col("status") == "FAILED_FOUND").alias("failed_found"), F.count_if(F.col("status") == "ERROR").alias("errors"), F.sum("cost_usd").alias("generation_usd")
    )
    told = log.read(FEEDBACK)
    if told is None:
        return rows.withColumn("feedback_usd", F.lit(0.0))
    costs = told.groupBy("round").agg(F.sum("cost_usd").alias("feedback_usd"))
    return rows.join(costs, "round", "left").na.fill(0.0, ["feedback_usd"])
