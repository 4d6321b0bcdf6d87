"""Benchmark review, re-judging and cross-system evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import word_count


def skip_reason(satisfied: Column, text: Column, max_words: int) -> Column:
    """Why an item is not reviewed: criterion_satisfied (only if true), then too_long; else null."""
    return F.when(satisfied.eqNullSafe(True), "criterion_satisfied").when(word_count(text) > max_words, "too_long")


#: Fixed value: an acronym or code, which no phrase count can reject.
_CODE = r"(?U)\b[A-Z]{2,}\b|\d"


def can_reject(term: Column) -> Column:
    """A term of at most four words without an acronym or code may reject a question."""
    return (word_count(term) <= 4) & ~term.rlike(_CODE)


def rejudge_outcome(verdict: Column, satisfied: Column) -> Column:
    """now_passes, failed_other_issues (failed although the criterion holds) or still_fails."""
    return (
        F.when(verdict == "PASSED", "now_passes").when(satisfied.eqNullSafe(True), "failed_other_issues").otherwise("still_fails")
    )


def crosstab(rows: DataFrame, key: str, decision: str) -> DataFrame:
    """Counts by key and decision; a null key is the text None."""
    return rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("None")).alias("key"), F.col(decision).alias("decision")).agg(
        F.count(F.lit(1)).alias("n")
    )


def open_slots(samples: DataFrame, systems: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, system) without a verdict, a sample's own target left out; systems are a small dimension."""
    wanted = samples.join(F.broadcast(systems)).filter("system <> target").select("id", "system")
    return wanted.join(verdicts.select("id", "system"), ["id", "system"], "left_anti")


def system_summary(verdicts: DataFrame) -> DataFrame:
    """Verdict counts by system over long rows (id, target, system, verdict), own targets left out."""
    return (
        verdicts.filter("system <> target")
        .groupBy("system")
        .agg(
            F.count("verdict").alias("judged"),
            F.count_if(F.col("verdict") == "FAILED").alias("failed"),
            F.count_if(F.col("verdict") == "PASSED").alias("passed"),
        )
        .withColumn("fail_rate", F.try_divide("failed", "judged"))
    )


def failed_by_all(verdicts: DataFrame, n_samples: int | Column, missing_fails: bool = False) -> DataFrame:
    """Per sample, whether every fully covered system failed it.

    A system is full if it judged at least half of the samples.  A missing verdict is no
    failure, unless `missing_fails`.
    """
    full = verdicts.groupBy("system").agg(F.count("verdict").alias("n")).filter(F.col("n") * 2 >= n_samples).select("system")
    fails = F.coalesce(F.col("verdict") == "FAILED", F.lit(missing_fails))
    return verdicts.join(F.broadcast(full), "system").groupBy("id").agg(F.bool_and(fails).alias("failed_by_all"))


def coverage(verdicts: DataFrame, sample: str, system: str, verdict: str) -> DataFrame:
    """(system, answered, is_full, complete, failed_by_all) of verdicts, a row a sample and system.

    A system is full if it answered at least half of the samples; the two counts, the same in
    every row, look at full systems only: samples they have all answered, and all failed.  Without a full
    system both are 0.
    """
    n = verdicts.select(sample).distinct().count()
    told = verdicts.groupBy(system).agg(F.count(verdict).alias("answered")).withColumn("is_full", F.col("answered") * 2 >= F.lit(n))
    full = told.filter("is_full").select(system)
    kept = verdicts.join(full, system, "left_semi").groupBy(sample).agg(F.count(verdict).alias("a"), F.count_if(F.col(verdict) == "FAILED").alias("f"))
    size = full.agg(F.count(F.lit(1)).alias("k"))
    sums = kept.join(F.broadcast(size)).agg(F.count_if((F.col("a") == F.col("k")) & (F.col("k") > 0)).alias("complete"), F.count_if((F.col("f") == F.col("k")) & (F.col("k") > 0)).alias("failed_by_all"))
    return told.join(F.broadcast(sums))


def decision_tables(rows: DataFrame, keys: list[str], decision: str, costs: str) -> DataFrame:
    """(key, value, decision, n, cost) of decisions by each of several keys, and over all (key `all`), in one pass.

    A null value or decision is one of its own, shown as null.
    """
    sets = [[decision, k] for k in keys] + [[decision]]
    rolled = rows.groupingSets([[F.col(c) for c in one] for one in sets], *[F.col(c) for c in [decision, *keys]])
    counted = rolled.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(costs), 4).alias("cost"), *[F.grouping(k).alias(f"__{k}") for k in keys])
    name = value = None
    for k in keys:
        here = F.col(f"__{k}") == 0
        name = F.when(here, k) if name is None else name.when(here, k)
        value = F.when(here, F.col(k).cast("string")) if value is None else value.when(here, F.col(k).cast("string"))
    return counted.select(name.otherwise("all").alias("key"), value.alias("value"), decision, "n", "cost")


def review_counters(rows: DataFrame) -> DataFrame:
    """One row of a review's counters: items, judged, errors, passes, revisions, rejections, missing rewrites, skipped by reason."""
    is_ = lambda d: F.count_if(F.col("decision") == d)
    return rows.agg(
        F.count(F.lit(1)).alias("items"), F.count("model").alias("judged"), is_("error").alias("errors"), is_("pass").alias("passes"), is_("revise").alias("revisions"), is_("reject").alias("rejections"),
        F.count_if("missing_rewrite").alias("missing_rewrites"), F.count_if(F.col("skip_reason") == "too_long").alias("too_long"), F.count_if(F.col("skip_reason") == "criterion_satisfied").alias("satisfied"),
    )
