"""External calls as tables: keyed requests, recorded answers, prices, and logs whose batches commit once.

Nothing here opens a connection.  A responder is a function from requests to answers: a join
with recorded answers (`replay`), or whatever a deployment maps over the requests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions.scalar import token_cost
from quarry.operators.dedup import latest_wins
from quarry.storage import finished_folders

Responder = Callable[[DataFrame], DataFrame]

USAGE = "input_tokens bigint, output_tokens bigint, cache_write_tokens bigint, cache_read_tokens bigint, reasoning_tokens bigint"
ANSWER = f"key string, text string, usage struct<{USAGE.replace(' bigint', ':bigint')}>, error string"
_LOG = f"{ANSWER}, model string, cost_usd double"


def request_key(*parts: Column) -> Column:
    """A key of the parts: equal only where all parts are equal, null apart from empty."""
    coded = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*coded), 256)


def usage(**counts: Column) -> Column:
    """A usage struct; counts not given, or null, are 0."""
    names = [field.split()[0] for field in USAGE.split(", ")]
    return F.struct(*[F.coalesce(counts.get(n, F.lit(0)).cast("bigint"), F.lit(0).cast("bigint")).alias(n) for n in names])


def folded_usage(prompt: Column, completion: Column, cached: Column, reasoning: Column) -> Column:
    """Usage of a provider that counts cached tokens into the prompt: they are taken out, never below 0."""
    zero = F.lit(0)
    uncached = F.greatest(F.coalesce(prompt, zero) - F.coalesce(cached, zero), zero)
    return usage(input_tokens=uncached, output_tokens=completion, cache_read_tokens=cached, reasoning_tokens=reasoning)


def unfolded_usage(prompt: Column, completion: Column) -> Column:
    """Usage as the clusterer reads it of such a provider: the cached tokens stay in the prompt."""
    return usage(input_tokens=prompt, output_tokens=completion)


def replay(recorded: DataFrame) -> Responder:
    """Answers from a table (key, text, usage, error), one row a key; a key without one is the error NotRecorded."""

    def respond(requests: DataFrame) -> DataFrame:
        told = recorded.select("key", "text", "usage", "error", F.lit(True).alias("__told"))
        missing = F.when(F.col("__told").isNull(), F.lit("NotRecorded"))
        return requests.join(told, "key", "left").select("key", "text", "usage", F.coalesce("error", missing).alias("error"))

    return respond


def checked(answers: DataFrame) -> DataFrame:
    """Answers in which one without text is the error EmptyResponse; what it used stays and is charged."""
    blank = F.col("error").isNull() & (F.trim(F.coalesce("text", F.lit(""))) == "")
    return answers.withColumn("error", F.when(blank, "EmptyResponse").otherwise(F.col("error")))


def priced(answers: DataFrame, pricing: DataFrame) -> DataFrame:
    """`answers` with cost_usd by (model, rate_in, rate_out) per million tokens; an unknown model costs 0."""
    counts = {k: F.col(f"usage.{k}_tokens") for k in ("input", "output", "cache_write", "cache_read")}
    cost = token_cost(counts, F.coalesce("rate_in", F.lit(0.0)), F.coalesce("rate_out", F.lit(0.0)))
    rates = pricing.select("model", F.col("rate_in").cast("double"), F.col("rate_out").cast("double"))
    return answers.join(rates, "model", "left").withColumn("cost_usd", cost).drop("rate_in", "rate_out")


class CallLog:
    """Answers with their prices in the batches of a folder.

    A batch is a folder that counts once its write has finished.  A batch repeated after that
    does nothing; one that was stopped leaves nothing that counts and is written anew.  So a
    key has one answered row and one charge, however often its batch is repeated.
    """

    def __init__(self, spark: SparkSession, path: str, pricing: DataFrame) -> None:
        self.spark, self.path, self.pricing = spark, path.rstrip("/"), pricing

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def rows(self) -> DataFrame:
        """(key, text, usage, error, model, cost_usd, batch) of all finished batches."""
        folders = finished_folders(self.spark, f"{self.path}/batch=*")
        schema = StructType.fromDDL(f"{_LOG}, batch bigint")
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders)

    def latest(self) -> DataFrame:
        """The latest row of each key; an answer is never replaced by a later error."""
        return latest_wins(self.rows(), ["key"], F.col("error").isNotNull(), F.col("batch"))

    def charges(self) -> DataFrame:
        """(key, calls, cost_usd, first_batch): what was asked and paid for each key, errors included."""
        return self.rows().groupBy("key").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd"), F.min("batch").alias("first_batch"))

    def spent(self) -> float:
        return self.rows().agg(F.sum("cost_usd")).first()[0] or 0.0

    def commit(self, batch: int, requests: DataFrame, respond: Responder) -> None:
        """Ask what `requests` (key, model, prompt) has without an answer yet, each key once, and commit answers and prices together.

        Requests without a key are not asked.
        """
        if finished_folders(self.spark, self._folder(batch)):
            return
        answered = self.latest().filter("error IS NULL").select("key")
        first = requests.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("model", "prompt")).alias("r"))
        open_ = first.select("key", "r.*").join(answered, "key", "left_anti")
        told = checked(respond(open_)).join(open_.select("key", "model"), "key")
        columns = [field.name for field in StructType.fromDDL(_LOG)]
        priced(told, self.pricing).select(*columns).write.mode("overwrite").parquet(self._folder(batch))

    def commit_within(self, cap: float, batch: int, requests: DataFrame, respond: Responder) -> bool:
        """`commit` unless the spend has reached `cap`; whether the batch was begun."""
        if self.spent() >= cap:
            return False
        self.commit(batch, requests, respond)
        return True

    def sink(self, requests: DataFrame, respond: Responder, checkpoint: str, once: bool = True):  # noqa: ANN201
        """Run a stream of requests through the log; the stream's batch number is the log's, so a repeated batch is no second charge."""
        writer = requests.writeStream.foreachBatch(lambda rows, number: self.commit(number, rows, respond)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


#: The fields that a label answer must have, and the words two of them may take.
LABELS = {"English": "boolean", "Clarity": "string", "Research Question": "boolean", "Request Type": "string", "Usable": "boolean"}
CLARITY = ("clear", "vague", "needs clarification")
REQUEST_TYPE = ("information seeking", "design", "review")


def labels(text: Column) -> Column:
    """A struct (english, clarity, research_question, request_type, usable) of an answer in JSON; null unless it has all fields and known words."""
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in LABELS.items())
    read = F.from_json(text, ddl)
    fields = {name: read.getField(name) for name in LABELS}
    valid = fields["Clarity"].isin(*CLARITY) & fields["Request Type"].isin(*REQUEST_TYPE)
    for value in fields.values():
        valid &= value.isNotNull()
    return F.when(valid, F.struct(*[value.alias(name.lower().replace(" ", "_")) for name, value in fields.items()]))


def answer_then_judge(samples: DataFrame, batch: int, answers: CallLog, verdicts: CallLog, answerer: Responder, judge: Responder) -> None:
    """One run over `samples` (key, model, prompt, judge_model): answers are committed before any is judged.

    A sample with a verdict is left alone; one whose judging failed is judged again without asking for its answer again.
    """
    judged = verdicts.latest().filter("error IS NULL").select("key")
    open_ = samples.join(judged, "key", "left_anti")
    answers.commit(batch, open_.select("key", "model", "prompt"), answerer)
    given = answers.latest().filter("error IS NULL").select("key", "text")
    asked = open_.join(given, "key").select("key", F.col("judge_model").alias("model"), F.concat_ws("\n\n", "prompt", "text").alias("prompt"))
    verdicts.commit(batch, asked, judge)


def judged_samples(samples: DataFrame, answers: CallLog, verdicts: CallLog) -> DataFrame:
    """`samples` with verdict, error, answer_cost, judge_cost, answer_calls, judge_calls and answer_reused.

    A verdict other than PASSED or FAILED is null.  An answer is reused where its verdict came in a later batch.
    """
    answer = answers.latest().select("key", F.col("error").alias("__answer_error"), F.col("batch").alias("__answered"))
    verdict = verdicts.latest().select("key", "text", F.col("error").alias("__judge_error"), F.col("batch").alias("__judged"))
    paid = [log.charges().select("key", F.col("calls").alias(f"{name}_calls"), F.col("cost_usd").alias(f"{name}_cost")) for name, log in (("answer", answers), ("judge", verdicts))]
    joined = samples.join(answer, "key", "left").join(verdict, "key", "left").join(paid[0], "key", "left").join(paid[1], "key", "left")
    zero = F.lit(0)
    return joined.select(
        *samples.columns,
        F.when(F.col("__judge_error").isNull() & F.col("text").isin("PASSED", "FAILED"), F.col("text")).alias("verdict"),
        F.coalesce("__answer_error", "__judge_error").alias("error"),
        *[F.coalesce(f"{name}_{what}", zero).alias(f"{name}_{what}") for name in ("answer", "judge") for what in ("cost", "calls")],
        F.coalesce(F.col("__judge_error").isNull() & (F.col("__answered") < F.col("__judged")), F.lit(False)).alias("answer_reused"),
    )
