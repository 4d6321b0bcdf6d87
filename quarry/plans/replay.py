"""Queries over replayed calls: labels of queries, and answers that are kept before they are judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import calls
from quarry.plans.registry import query, table
from quarry.storage import fresh_path

_PRICES = [("label-en", 1.25, 10.0), ("label-de", 0.25, 2.0), ("label-fr", 3.0, 15.0), ("answer", 3.0, 15.0), ("judge", 1.25, 10.0)]


def _pricing(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{model}', {rate_in}D, {rate_out}D)" for model, rate_in, rate_out in _PRICES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(model, rate_in, rate_out)")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("label-"), F.coalesce("lang", F.lit("none"))).alias("model"), "n_chars")
    return docs.withColumn("key", calls.request_key(F.col("model"), F.col("text")))


@query("""WITH docs AS (SELECT doc_id, 'label-' || coalesce(lang, 'none') AS model, coalesce(text, '') AS text, n_chars FROM documents),
keyed AS (SELECT model, text, min(n_chars) AS n_chars, min(doc_id) FILTER (quality IS NOT NULL) AS told FROM docs LEFT JOIN labels USING (doc_id) GROUP BY model, text),
asked AS (SELECT k.*, l.quality, l.toxic, l.toxic IS NOT DISTINCT FROM 1 AS refused,
 CASE model WHEN 'label-en' THEN 1.25 WHEN 'label-de' THEN 0.25 WHEN 'label-fr' THEN 3 ELSE 0 END AS rate_in,
 CASE model WHEN 'label-en' THEN 10 WHEN 'label-de' THEN 2 WHEN 'label-fr' THEN 15 ELSE 0 END AS rate_out FROM keyed k LEFT JOIN labels l ON l.doc_id = k.told),
paid AS (SELECT *, told IS NULL OR refused AS failed, CASE WHEN told IS NULL THEN 0.0 ELSE (greatest(n_chars // 4 - told % 50, 0) * rate_in + 12 * rate_out + (told % 50) * rate_in * 0.10) / 1e6 END AS once FROM asked)
SELECT doc_id, CASE WHEN NOT failed THEN model = 'label-en' END AS english, CASE WHEN NOT failed THEN CASE WHEN quality = 1 THEN 'clear' ELSE 'vague' END END AS clarity,
 CASE WHEN NOT failed THEN quality = 1 AND model = 'label-en' END AS usable, CASE WHEN told IS NULL THEN 'NotRecorded' WHEN refused THEN 'EmptyResponse' END AS error,
 CAST(CASE WHEN failed THEN 2 ELSE 1 END AS BIGINT) AS calls, round(CASE WHEN failed THEN 2 ELSE 1 END * once, 9) AS cost_usd FROM docs JOIN paid USING (model, text)""")
def replayed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each document labelled by the replayed answer to its text: one call a text, a repeated batch is no second charge, errors are asked again once."""
    docs = _labelled(spark, d)
    told = docs.join(table(spark, d, "labels"), "doc_id").groupBy("key").agg(F.min_by(F.struct("doc_id", "quality", "toxic", "model"), "doc_id").alias("t"))
    sized = told.join(docs.groupBy("key").agg(F.min("n_chars").alias("n_chars")), "key")
    english = F.col("t.model") == "label-en"
    clear = F.col("t.quality") == 1
    answer = F.to_json(
        F.struct(
            english.alias("English"), F.when(clear, "clear").otherwise("vague").alias("Clarity"), F.lit(True).alias("Research Question"),
            F.lit("information seeking").alias("Request Type"), (clear & english).alias("Usable"),
        )
    )
    used = calls.folded_usage(F.expr("n_chars div 4"), F.lit(12), F.col("t.doc_id") % 50, F.lit(0))
    recorded = sized.select("key", F.when(F.col("t.toxic") == 0, answer).alias("text"), used.alias("usage"), F.lit(None).cast("string").alias("error"))
    log = calls.CallLog(spark, fresh_path(spark, "labels"), _pricing(spark))
    requests = docs.select("key", "model", F.col("text").alias("prompt"))
    for batch in range(2):
        part = requests.filter(F.pmod(F.xxhash64("key"), F.lit(2)) == batch)
        log.commit(batch, part, calls.replay(recorded))
        log.commit(batch, part, calls.replay(recorded))
    log.commit(2, requests, calls.replay(recorded))
    read = log.latest().select("key", calls.labels(F.col("text")).alias("l"), "error")
    paid = log.charges().select("key", "calls", F.round("cost_usd", 9).alias("cost_usd"))
    found = docs.select("doc_id", "key").join(read, "key").join(paid, "key")
    return found.select("doc_id", "l.english", "l.clarity", "l.usable", "error", "calls", "cost_usd")


@query("""WITH s AS (SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))
SELECT doc_id, lang, CASE WHEN quality = 0 THEN 'FAILED' ELSE 'PASSED' END AS verdict, round((doc_id % 100 * 3 + n_chars // 4 * 15) / 1e6, 9) AS answer_cost,
 round((n_chars // 4 * 1.25 + 20 * 10) / 1e6 * CASE WHEN toxic = 1 THEN 2 ELSE 1 END, 9) AS judge_cost, 1::BIGINT AS answer_calls,
 CASE WHEN toxic = 1 THEN 2 ELSE 1 END::BIGINT AS judge_calls, toxic = 1 AS answer_reused FROM s""")
def prejudged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers and verdicts of two runs; where the first run's judge fails, the second judges the kept answer and pays for no other."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", "n_chars").join(table(spark, d, "labels"), "doc_id")
    keyed = docs.withColumn("key", calls.request_key(F.col("doc_id"), F.col("lang")))
    samples = keyed.select("key", "doc_id", "lang", F.lit("answer").alias("model"), F.lit("judge").alias("judge_model"), F.substring("text", 1, 80).alias("prompt"))
    length = F.expr("n_chars div 4")
    none = F.lit(None).cast("string")
    answered = keyed.select("key", F.concat(F.lit("Answer: "), F.coalesce("text", F.lit(""))).alias("text"), calls.usage(input_tokens=F.col("doc_id") % 100, output_tokens=length).alias("usage"), none.alias("error"))
    used = calls.usage(input_tokens=length, output_tokens=F.lit(20)).alias("usage")
    verdict = F.when(F.col("quality") == 0, "FAILED").otherwise("PASSED").alias("text")
    second = keyed.select("key", verdict, used, none.alias("error"))
    first = keyed.select("key", verdict, used, F.when(F.col("toxic") == 1, "RateLimit").alias("error"))
    root = fresh_path(spark, "prejudged")
    answers, verdicts = (calls.CallLog(spark, f"{root}/{name}", _pricing(spark)) for name in ("answers", "verdicts"))
    for batch, judge in enumerate((first, second)):
        calls.answer_then_judge(samples, batch, answers, verdicts, calls.replay(answered), calls.replay(judge))
    told = calls.judged_samples(samples, answers, verdicts)
    return told.select("doc_id", "lang", "verdict", F.round("answer_cost", 9).alias("answer_cost"), F.round("judge_cost", 9).alias("judge_cost"), "answer_calls", "judge_calls", "answer_reused")
