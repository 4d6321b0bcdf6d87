"""Loops of rounds that are killed after any stage and resumed."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import rounds
from quarry.storage import fresh_path


def make_loop(spark, calls):
    seeds = spark.createDataFrame([(i, i % 3, "x" if i % 2 else "y") for i in range(18)], "seed int, round int, cell string")

    def generate(own, menus):
        calls.append("generate")
        banned = menus.agg(F.count(F.lit(1)).alias("banned"))
        status = F.when(F.col("seed") % 4 == 0, "FAILED_FOUND").otherwise("EXHAUSTED")
        return own.select("seed", status.alias("status"), F.lit(0.1).alias("cost_usd")).crossJoin(banned)

    def feedback(attempts):
        calls.append("feedback")
        return attempts.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("cost_usd", F.lit(1.0))

    def menus(told):
        return spark.createDataFrame([], "name string") if told is None else told.filter("n > 2").select(F.col("status").alias("name"))

    return rounds.Loop(seeds, generate, feedback, menus)


def tables(log):
    return {s: sorted(map(str, log.read(s).collect())) for s in ("generation-*", "feedback", "menus")}


@pytest.fixture(scope="module")
def whole(spark):
    log = rounds.RoundLog(spark, fresh_path(spark, "whole"))
    run = rounds.run_rounds(log, make_loop(spark, []))
    assert (run.ended, run.round, run.fresh_rounds) == ("finished", 2, 3)
    assert run.spent == pytest.approx(18 * 0.1 + 4 * 1.0)
    return tables(log)


@pytest.mark.parametrize("kill_at", [1, 3, 4, 6, 9])
def test_killed_and_resumed(spark, whole, monkeypatch, kill_at):
    log, done = rounds.RoundLog(spark, fresh_path(spark, "killed")), []
    stage = log.stage

    def dying(number, name, make):
        if len(done) == kill_at:
            done.append("killed")
            raise KeyboardInterrupt
        done.append(name)
        return stage(number, name, make)

    monkeypatch.setattr(log, "stage", dying)
    with pytest.raises(KeyboardInterrupt):
        rounds.run_rounds(log, make_loop(spark, []))
    calls = []
    assert rounds.run_rounds(log, make_loop(spark, calls)).ended == "finished"
    assert tables(log) == whole
    # What was finished before is not made again.
    assert len(calls) + sum(n != "menus" for n in done[:kill_at]) == 8


def test_pauses_and_reused_feedback(spark, whole):
    log, calls, ends, spent = rounds.RoundLog(spark, fresh_path(spark, "paused")), [], [], 0.0
    while not ends or ends[-1] != "finished":
        run = rounds.run_rounds(log, make_loop(spark, calls), stop_after=1)
        ends.append(run.ended)
        spent += run.spent
    assert ends == ["paused", "paused", "finished"] and tables(log) == whole
    assert calls.count("feedback") == 2 and spent == pytest.approx(18 * 0.1 + 4 * 1.0)
    again = rounds.run_rounds(log, make_loop(spark, calls), stop_after=1)
    assert (again.ended, again.fresh_rounds, again.spent) == ("finished", 0, 0.0)


def test_budget(spark):
    log = rounds.RoundLog(spark, fresh_path(spark, "budget"))
    run = rounds.run_rounds(log, make_loop(spark, []), budget=0.25)
    assert (run.ended, run.round) == ("stopped", 0) and run.spent == pytest.approx(0.3)
    assert rounds.run_rounds(log, make_loop(spark, []), budget=0.0).ended == "stopped"
    assert [r.seeds for r in rounds.manifest(log).collect()] == [3]


def test_cells_must_be_complete(spark):
    loop = make_loop(spark, [])
    short = rounds.Loop(loop.seeds, lambda own, menus: loop.generate(own, menus).filter("seed > 2"), loop.feedback, loop.menus)
    with pytest.raises(ValueError, match="round 0, cell y: 1 seeds"):
        rounds.run_rounds(rounds.RoundLog(spark, fresh_path(spark, "short")), short)
