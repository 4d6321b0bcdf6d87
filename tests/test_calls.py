"""Call logs: batches that are stopped and repeated, answers kept before judging, prices."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import calls
from quarry.storage import fresh_path

PRICES = "VALUES ('m', 2.0D, 10.0D), ('j', 1.0D, 1.0D) AS t(model, rate_in, rate_out)"


@pytest.fixture
def log(spark):
    return calls.CallLog(spark, fresh_path(spark, "log"), spark.sql(f"SELECT * FROM {PRICES}"))


def requests(spark, keys):
    return spark.createDataFrame([(k, "m", f"ask {k}") for k in keys], "key string, model string, prompt string")


def respond(asked, broken=()):
    def run(open_):
        asked.extend(r.key for r in open_.collect())
        bad = F.col("key").isin(*broken) if broken else F.lit(False)
        used = calls.usage(input_tokens=F.lit(1000), output_tokens=F.lit(100))
        return open_.select("key", F.concat(F.lit("re "), "prompt").alias("text"), used.alias("usage"), F.when(bad, "RateLimit").alias("error"))

    return run


def test_repeated_batches_charge_once(spark, log):
    asked = []
    for _ in range(2):
        log.commit(0, requests(spark, ["a", "b", "b"]), respond(asked))
        log.commit(1, requests(spark, ["b", "c"]), respond(asked))
    assert sorted(asked) == ["a", "b", "c"]
    assert sorted((r.key, r.calls, r.cost_usd) for r in log.charges().collect()) == [(k, 1, 0.003) for k in "abc"]


def test_stopped_batch_leaves_nothing(spark, log, monkeypatch):
    def broken(open_):
        return respond([])(open_).withColumn("text", F.when(F.col("key") == "b", F.raise_error(F.lit("killed"))).otherwise(F.col("text")))

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            log.commit(0, requests(spark, ["a", "b"]), broken)
        assert log.rows().isEmpty()
    # Files of a write that never finished do not count either.
    requests(spark, ["z"]).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").mode("overwrite").parquet(f"{log.path}/batch=0")
    assert log.rows().isEmpty()
    log.commit(0, requests(spark, ["a", "b"]), respond([]))
    assert sorted(r.key for r in log.rows().collect()) == ["a", "b"]
    assert log.spent() == pytest.approx(0.006)


def test_errors_are_asked_again_and_charged(spark, log):
    log.commit(0, requests(spark, ["a", "b"]), respond([], broken=["a"]))
    asked = []
    log.commit(1, requests(spark, ["a", "b"]), respond(asked))
    assert asked == ["a"]
    assert sorted((r.key, r.error) for r in log.latest().collect()) == [("a", None), ("b", None)]
    assert {r.key: r.calls for r in log.charges().collect()} == {"a": 2, "b": 1}
    assert not log.commit_within(0.001, 2, requests(spark, ["d"]), respond(asked))
    assert log.commit_within(1.0, 2, requests(spark, ["d"]), respond(asked))


def test_stream_of_requests(spark, log, tmp_path):
    requests(spark, ["a", "b"]).repartition(2).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("key string, model string, prompt string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        used = calls.usage(input_tokens=F.lit(1), output_tokens=F.lit(1))
        log.sink(stream, lambda r: r.select("key", F.lit("x").alias("text"), used.alias("usage"), F.lit(None).cast("string").alias("error")), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.key for r in log.rows().collect()) == ["a", "b"]


def test_answers_are_kept_for_the_judge(spark):
    prices = spark.sql(f"SELECT * FROM {PRICES}")
    answers, verdicts = (calls.CallLog(spark, fresh_path(spark, name), prices) for name in ("answers", "verdicts"))
    samples = spark.createDataFrame([("a", "m", "q", "j"), ("b", "m", "q", "j")], "key string, model string, prompt string, judge_model string")
    asked = []
    judge = lambda broken: lambda r: respond([], broken)(r).withColumn("text", F.lit("PASSED"))
    for batch, broken in enumerate((["a"], [])):
        calls.answer_then_judge(samples, batch, answers, verdicts, respond(asked), judge(broken))
    assert sorted(asked) == ["a", "b"]
    rows = {r.key: r for r in calls.judged_samples(samples, answers, verdicts).collect()}
    assert [(rows[k].verdict, rows[k].answer_calls, rows[k].judge_calls, rows[k].answer_reused) for k in "ab"] == [("PASSED", 1, 2, True), ("PASSED", 1, 1, False)]


def test_usage_and_empty_answers(spark):
    row = spark.range(1).select(
        calls.folded_usage(F.lit(10), F.lit(5), F.lit(30), F.lit(2)).alias("folded"), calls.folded_usage(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("none"),
        calls.unfolded_usage(F.lit(10), F.lit(5)).alias("unfolded"),
    ).first()
    assert (row.folded.input_tokens, row.folded.cache_read_tokens, row.folded.reasoning_tokens) == (0, 30, 2)
    assert set(row.none.asDict().values()) == {0}
    assert (row.unfolded.input_tokens, row.unfolded.cache_read_tokens) == (10, 0)
    told = spark.createDataFrame([("a", " ", None), ("b", "x", None), ("c", None, "Timeout")], "key string, text string, error string")
    assert [r.error for r in calls.checked(told).orderBy("key").collect()] == ["EmptyResponse", None, "Timeout"]


def test_label_fields(spark):
    good = '{"English":true,"Clarity":"vague","Research Question":true,"Request Type":"design","Usable":false}'
    rows = [good, good.replace("vague", "odd"), good.replace('"Usable":false', '"x":1'), "no json", None]
    found = [r.l for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(calls.labels(F.col("t")).alias("l")).collect()]
    assert found[0].request_type == "design" and found[0].english and not found[0].usable
    assert found[1:] == [None] * 4


def test_keys_tell_null_from_empty(spark):
    keys = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None), (None, "ab"), ("", "ab")], "x string, y string").select(calls.request_key(F.col("x"), F.col("y")).alias("k")).collect()
    assert len({r.k for r in keys}) == 5
