"""Sources, sinks, the streaming view and the loops on small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators import loops, traces
from quarry.sources import files, sinks
from quarry.streaming import call_log

RUN = "results array<struct<seed string, status string, attempts array<struct<question string, verdict string>>>>"


def test_lines_drop_blanks_and_comments(spark, tmp_path):
    path = tmp_path / "seeds.txt"
    path.write_text("  one \n\n# two\n\tthree\n")
    assert [r.line for r in files.lines(spark, str(path)).collect()] == ["one", "# two", "three"]
    assert [r.line for r in files.lines(spark, str(path), comments=True).collect()] == ["one", "three"]


def test_json_lines_skip_or_refuse_broken_ones(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"id": 1, "x": "a"}\n{"id": 2, "x"\n{"id": 3}\n')
    schema = StructType.fromDDL("id bigint, x string")
    assert [tuple(r) for r in files.json_lines(spark, str(path), schema).collect()] == [(1, "a"), (3, None)]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.json_lines(spark, str(path), schema, strict=True).collect()


def test_run_documents_and_attempts(spark, tmp_path):
    cell = tmp_path / "round_02" / "alpha" / "plain"
    flat = tmp_path / "runs"
    cell.mkdir(parents=True)
    flat.mkdir()
    steps = [{"question": "q0", "verdict": "PASSED"}, {"question": "q1", "verdict": "FAILED"}]
    (cell / "sample_001.json").write_text(json.dumps({"results": [{"seed": "s", "status": "FAILED_FOUND", "attempts": steps}]}))
    (flat / "sample_002.json").write_text(json.dumps({"results": [{"seed": "t", "status": "ERROR", "attempts": []}]}))
    (flat / "sample_003.json").write_text("{ broken")
    (flat / "other.json").write_text("{}")
    runs = files.run_documents(spark, str(tmp_path), StructType.fromDDL(RUN))
    places = {(r.source_run, r.round, r.system, r.prompt) for r in runs.collect()}
    assert places == {("alpha/plain", 2, "alpha", "plain"), ("runs", None, None, None)}
    rows = files.attempts(runs).select("result.seed", "attempt_pos", "attempt.verdict", "is_last").collect()
    assert {tuple(r) for r in rows} == {("s", 0, "PASSED", False), ("s", 1, "FAILED", True), ("t", None, None, False)}


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, True), ("b", 2, True)], "k string, n int, bad boolean")
    for part in (log.filter("n = 1"), log.filter("n = 2")):
        sinks.append_lines(part, str(tmp_path / "log"))
    read = files.json_lines(spark, str(tmp_path / "log"), log.schema)
    sinks.compact(read, ["k"], F.col("bad"), F.col("n"), str(tmp_path / "compact"))
    kept = files.json_lines(spark, str(tmp_path / "compact"), log.schema)
    assert {tuple(r) for r in kept.collect()} == {("a", 1, False), ("b", 2, True)}
    with pytest.raises(Exception, match="EXISTS|exists"):
        sinks.write_once(log, str(tmp_path / "compact"))
    sinks.write_split(log, "k", str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).filter("k = 'b'").count() == 2


def test_streaming_spend_over_several_batches(spark, tmp_path):
    calls = spark.createDataFrame(
        [("2024-01-01 00:10:00", "judge", 1.0), ("2024-01-01 00:50:00", "judge", 2.0), ("2024-01-01 01:00:00", "error", 4.0)],
        "at string, kind string, cost double",
    ).withColumn("at", F.to_timestamp("at"))
    for n in range(2):
        calls.write.mode("append").parquet(str(tmp_path / "calls"))
    stream = call_log.read_calls(spark, str(tmp_path / "calls"), calls.schema, files=1)
    out = call_log.run_available(
        call_log.spend(stream, "at", "kind", "cost", F.col("kind") == "error", "1 hour"), ["window_start", "kind"]
    )
    got = {(r.window_start.hour, r.kind, r.calls, r.errors, r.cost) for r in out.collect()}
    assert {g[1:] for g in got} == {("judge", 4, 0, 6.0), ("error", 2, 2, 8.0)}


def test_budget_stops_between_batches(spark):
    items = spark.range(100).withColumnRenamed("id", "k")
    step = lambda batch: batch.withColumn("cost", F.lit(1.0))
    assert loops.within_budget(items, "k", step, "cost", 1e9, 4).count() == 100
    some = loops.within_budget(items, "k", step, "cost", 1.0, 4).count()
    assert 0 < some < 100
    assert loops.within_budget(items, "k", step, "cost", 0.0, 4).count() == 0


def test_attempt_loop_states(spark):
    seeds = spark.createDataFrame([("FP",), ("PPF",), ("PPP",), ("P",), ("",)], "k string")

    def attempt(open_seeds, n):
        letter = F.substring("k", n + 1, 1)
        return open_seeds.select("k", F.when(letter == "F", "FAILED").when(letter == "P", "PASSED").alias("verdict"))

    got = {r.k: (r.status, r.attempts) for r in loops.attempt_loop(seeds, "k", attempt, 2).collect()}
    assert got == {
        "FP": ("ALREADY_HARD", 0), "PPF": ("FAILED_FOUND", 2), "PPP": ("EXHAUSTED", 2), "P": ("ERROR", 1), "": ("ERROR", 0),
    }


def test_trace_references(spark):
    calls = spark.createDataFrame(
        [(1, ["a", "b"], ["x"]), (2, ["c"], ["y", "z"]), (3, None, ["w"])], "id int, documents array<string>, data array<string>"
    )
    got = {tuple(r) for r in traces.positional_sources(calls, "documents", "data").collect()}
    assert got == {(1, 0, "a", "x"), (1, 1, "b", None), (2, 0, "c", "y")}
    refs = spark.createDataFrame(
        [(1, 0, "u", "t", False), (1, 1, "", "t", None), (1, 2, "u", "s", True), (1, 3, None, "t", True)],
        "answer int, ord int, url string, title string, back boolean",
    )
    kept = traces.selected_refs(refs, "answer", "ord", "url", "title", "back").select("position", "ord", "title").collect()
    assert {tuple(r) for r in kept} == {(0, 2, "s"), (1, 3, "t")}
