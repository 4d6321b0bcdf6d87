"""Loops over bulk stages: attempts until a seed is decided, and batches until a budget is spent.

Only counts and sums reach the driver; each stage is written to the shared folder, so the
next one does not recompute it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.storage import materialize


def attempt_loop(seeds: DataFrame, key: str, attempt: Callable[[DataFrame, int], DataFrame], retries: int) -> DataFrame:
    """(key, status, attempts) for every seed with a unique non-null key.

    `attempt(open, n)` returns (key, verdict) for the seeds still open: FAILED ends a seed as
    ALREADY_HARD (n = 0) or FAILED_FOUND, PASSED leaves it open, any other verdict or none is
    an ERROR.  What is open after `retries` rewrites is EXHAUSTED.
    """
    open_seeds, ended = seeds, []
    for n in range(retries + 1):
        verdicts = attempt(open_seeds, n).select(key, "verdict")
        tried = materialize(open_seeds.select(key).join(verdicts, key, "left"), f"attempt-{n}")
        failed = "FAILED_FOUND" if n else "ALREADY_HARD"
        passed = "EXHAUSTED" if n == retries else None
        status = F.when(F.col("verdict") == "FAILED", failed).when(F.col("verdict") == "PASSED", F.lit(passed)).otherwise("ERROR")
        labelled = tried.select(key, status.alias("status"), F.lit(n).alias("attempts"))
        ended.append(labelled.filter(F.col("status").isNotNull()))
        still = labelled.filter(F.col("status").isNull())
        if still.isEmpty():
            break
        open_seeds = seeds.join(still.select(key), key, "left_semi")
    return reduce(DataFrame.unionByName, ended)


def within_budget(items: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], cost: str, cap: float, batches: int) -> DataFrame:
    """Results of `step` over batches of items by key hash; no batch begins once the cost has reached `cap`.

    A running batch is finished, so the cap is passed by one batch at most.  A cap of 0 or
    less runs none and returns an empty table of the step's columns.
    """
    done, spent = [], 0.0
    for number in range(batches):
        if spent >= cap:
            break
        batch = items.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == number)
        done.append(materialize(step(batch), f"batch-{number}"))
        spent += done[-1].agg(F.sum(cost)).first()[0] or 0.0
    return reduce(DataFrame.unionByName, done) if done else step(items).limit(0)
