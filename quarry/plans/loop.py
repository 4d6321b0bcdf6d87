"""Queries on attempts, menus, splits and reviews.

Stand-ins: a user's events in order are a seed's attempts; error is a FAILED verdict,
purchase PASSED, signup a rejected criterion, view an accepted one without a verdict and
click an invalid verdict; the seed's status and run go by user_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scalar, text
from quarry.operators import examples, positions
from quarry.plans.registry import SQL_SPACE, query, table

_STATUS = ["ALREADY_HARD", "EXHAUSTED", "FAILED_FOUND", "ERROR"]

_ATTEMPTS = """a AS (SELECT user_id, event_id, ts, value, CAST(row_number() OVER w AS INTEGER) - 1 AS attempt,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_last,
 CASE user_id % 4 WHEN 0 THEN 'ALREADY_HARD' WHEN 1 THEN 'EXHAUSTED' WHEN 2 THEN 'FAILED_FOUND' ELSE 'ERROR' END AS status,
 'run' || (user_id % 3) AS run, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'PASSED' WHEN 'click' THEN 'MAYBE' END AS verdict,
 CASE event_type WHEN 'signup' THEN ' Incorrect ' WHEN 'view' THEN 'partly_correct' END AS label,
 CASE WHEN event_id % 29 = 0 THEN '' ELSE 'q' || (event_id % 997) END AS question,
 CASE WHEN event_id % 12 = 0 THEN '  ' ELSE 's' || (event_id % 12) END AS strategy
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, coalesce(verdict = 'FAILED', false) AS failed FROM a WHERE status <> 'ERROR' AND question <> '' AND attempt <> 0
 AND (verdict IN ('PASSED', 'FAILED') OR lower(trim(label)) = 'incorrect'))"""


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind, n = F.col("event_type"), F.col("event_id")
    return events.select(
        "user_id",
        "event_id",
        "ts",
        "value",
        (F.row_number().over(w) - 1).alias("attempt"),
        F.lead(F.lit(1)).over(w).isNull().alias("is_last"),
        F.get(F.lit(_STATUS), (F.col("user_id") % 4).cast("int")).alias("status"),
        F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run"),
        F.when(kind == "error", "FAILED").when(kind == "purchase", "PASSED").when(kind == "click", "MAYBE").alias("verdict"),
        F.when(kind == "signup", " Incorrect ").when(kind == "view", "partly_correct").alias("label"),
        F.when(n % 29 == 0, "").otherwise(F.concat(F.lit("q"), (n % 997).cast("string"))).alias("question"),
        F.when(n % 12 == 0, "  ").otherwise(F.concat(F.lit("s"), (n % 12).cast("string"))).alias("strategy"),
    )


@query(f"""WITH {_ATTEMPTS} SELECT event_id, CASE WHEN is_last AND status = 'ALREADY_HARD' THEN 'ALREADY_HARD (seed already hard; no rewrite)'
 WHEN is_last AND status = 'EXHAUSTED' THEN 'EXHAUSTED (no failing answer found; hardest attempt) | ' || strategy ELSE strategy END AS strategy FROM a""")
def attempt_strategy_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _attempts(spark, d)
    return rows.select("event_id", examples.strategy_label(F.col("status"), F.col("strategy"), F.col("is_last")).alias("strategy"))


@query(f"""WITH {_ATTEMPTS} SELECT event_id, CASE WHEN verdict <> 'MAYBE' THEN verdict END AS verdict, coalesce(label = ' Incorrect ', false) AS rejected,
 coalesce(CASE label WHEN ' Incorrect ' THEN 'incorrect' WHEN 'partly_correct' THEN 'almost_correct' END, '') AS label FROM a""")
def attempt_verdicts(spark: SparkSession, d: str) -> DataFrame:
    verdict, label = F.col("verdict"), F.col("label")
    return _attempts(spark, d).select(
        "event_id",
        examples.valid_verdict(verdict).alias("verdict"),
        examples.criterion_rejected(label).alias("rejected"),
        examples.criterion_label(label).alias("label"),
    )


@query(f"WITH {_ATTEMPTS} SELECT event_id, failed FROM g WHERE trim(strategy) <> ''")
def gated_attempts(spark: SparkSession, d: str) -> DataFrame:
    return examples.with_strategy(examples.gate(_attempts(spark, d))).select("event_id", "failed")


@query(f"""WITH {_ATTEMPTS} SELECT event_id, question, failed FROM (SELECT *, row_number() OVER (PARTITION BY question
 ORDER BY is_last DESC, user_id, attempt) AS r FROM g) WHERE r = 1""")
def questions_deciding_first(spark: SparkSession, d: str) -> DataFrame:
    kept = examples.first_questions(examples.gate(_attempts(spark, d)), ["user_id", "attempt"])
    return kept.select("event_id", "question", "failed")


@query(f"""WITH {_ATTEMPTS} SELECT event_id, run, question FROM (SELECT *, row_number() OVER (PARTITION BY run, question
 ORDER BY is_last DESC, user_id, attempt) AS r FROM g) WHERE r = 1""")
def questions_by_run(spark: SparkSession, d: str) -> DataFrame:
    kept = examples.first_questions(examples.gate(_attempts(spark, d)), ["user_id", "attempt"], per_run=True)
    return kept.select("event_id", "run", "question")


@query(f"""WITH {_ATTEMPTS} SELECT event_id, question AS updated_question, strategy, upper(coalesce(verdict, '')) = 'FAILED' AS failed,
 CASE WHEN upper(coalesce(verdict, '')) = 'FAILED' THEN 'FAILED' ELSE 'PASSED' END AS drtulu_verdict, run AS source_run, attempt AS round FROM a""")
def flat_instances(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    row = {c: F.col(c) for c in ("question", "strategy", "verdict")} | {
        "updated_question": none.cast("string"), "drtulu_verdict": none.cast("string"), "failed": none.cast("boolean"),
    }
    made = _attempts(spark, d).select("event_id", F.col("run").alias("source_run"), F.col("attempt").alias("round"), *[v.alias(k) for k, v in examples.coerced(row).items()])
    return made.withColumn("drtulu_verdict", F.when(F.col("failed"), "FAILED").otherwise("PASSED"))


@query(f"""WITH {_ATTEMPTS} SELECT user_id, string_agg(coalesce(verdict, '-'), '>' ORDER BY attempt) AS trail FROM a GROUP BY user_id""")
def attempt_trail(spark: SparkSession, d: str) -> DataFrame:
    step = F.struct("attempt", F.coalesce("verdict", F.lit("-")).alias("verdict"))
    grouped = _attempts(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return grouped.select("user_id", F.array_join("steps.verdict", ">").alias("trail"))


@query(f"""WITH {_ATTEMPTS} SELECT count(*) AS num_instances, count(CASE WHEN failed THEN 1 END) AS num_failed,
 round(count(CASE WHEN failed THEN 1 END) / count(*), 4) AS overall_failure_rate, string_agg(DISTINCT run, ',' ORDER BY run) AS source_runs,
 count(DISTINCT strategy) AS strategies_used FROM g""")
def feedback_meta(spark: SparkSession, d: str) -> DataFrame:
    failed = F.count_if("failed")
    return examples.gate(_attempts(spark, d)).agg(
        F.count(F.lit(1)).alias("num_instances"),
        failed.alias("num_failed"),
        F.round(failed / F.count(F.lit(1)), 4).alias("overall_failure_rate"),
        F.array_join(F.array_sort(F.collect_set("run")), ",").alias("source_runs"),
        F.countDistinct("strategy").alias("strategies_used"),
    )


@query(f"""WITH {_ATTEMPTS}, s AS (SELECT user_id, any_value(status) AS status, any_value(run) AS run, count(*) AS n, sum(value) AS cost FROM a GROUP BY user_id)
SELECT run, round(avg(CASE WHEN status = 'FAILED_FOUND' THEN n END), 4) AS mean_attempts, count(CASE WHEN status = 'FAILED_FOUND' THEN 1 END) AS found,
 round(sum(cost), 4) AS cost FROM s GROUP BY run""")
def mean_attempts_to_break(spark: SparkSession, d: str) -> DataFrame:
    seeds = _attempts(spark, d).groupBy("user_id", "status", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("cost"))
    found = F.col("status") == "FAILED_FOUND"
    return seeds.groupBy("run").agg(
        F.round(F.avg(F.when(found, F.col("n"))), 4).alias("mean_attempts"), F.count_if(found).alias("found"), F.round(F.sum("cost"), 4).alias("cost")
    )


@query(f"""WITH {_ATTEMPTS}, e AS (SELECT user_id, arg_min(event_type, event_id) AS m FROM events GROUP BY user_id)
SELECT left(string_split(m || ': ' || (user_id % 7), ':')[1], 50) AS bucket, count(*) AS n FROM e GROUP BY 1""")
def error_buckets(spark: SparkSession, d: str) -> DataFrame:
    message = F.concat("m", F.lit(": "), (F.col("user_id") % 7).cast("string"))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("m"))
    return rows.groupBy(F.left(F.substring_index(message, ":", 1), F.lit(50)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ATTEMPTS}, s AS (SELECT DISTINCT user_id, status FROM a) SELECT user_id, CAST(row_number() OVER (ORDER BY
 CASE status WHEN 'FAILED_FOUND' THEN 0 WHEN 'EXHAUSTED' THEN 1 WHEN 'ALREADY_HARD' THEN 2 ELSE 3 END, user_id) AS INTEGER) AS place, user_id // 10 AS block FROM s""")
def report_order(spark: SparkSession, d: str) -> DataFrame:
    """Seeds by status and then number, with the round (block of ten) that they belong to."""
    rank = F.array_position(F.lit(["FAILED_FOUND", "EXHAUSTED", "ALREADY_HARD", "ERROR"]), F.col("status"))
    seeds = _attempts(spark, d).select("user_id", "status").distinct().withColumn("rank", rank)
    placed = positions.numbered(seeds, ["rank", "user_id"], "place")
    return placed.select("user_id", (F.col("place") + 1).cast("int").alias("place"), F.expr("user_id div 10").alias("block"))


@query("SELECT user_id, bool_or(value > 200) AS fresh FROM events GROUP BY user_id")
def fresh_work(spark: SparkSession, d: str) -> DataFrame:
    resumed = F.col("value") <= 200
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(~F.coalesce(resumed, F.lit(False))).alias("fresh"))


# --- menus and worked examples ---

_CLUSTERS = """c AS (SELECT source, CAST(substr(source, 4) AS INTEGER) AS k, count(*) AS n, count(CASE WHEN quality = 0 THEN 1 END) AS num_failed
 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
x AS (SELECT *, CASE k % 5 WHEN 0 THEN '[novel strategy not in seed menu] e.g. Plan ' || source WHEN 1 THEN 'ALREADY_HARD x' WHEN 2 THEN '  Plan ' || source || ' '
 WHEN 3 THEN 'Something else' ELSE 'unclassified' END AS description FROM c),
y AS (SELECT *, CASE k % 5 WHEN 0 THEN 'Plan ' || source WHEN 2 THEN 'Plan ' || source WHEN 3 THEN 'Something else' ELSE '' END AS strategy FROM x)"""


def _descriptions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    rows = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 0).alias("num_failed"))
    k, plan = F.substring("source", 4, 9).cast("int"), F.concat(F.lit("Plan "), F.col("source"))
    kinds = [F.concat(F.lit(examples.NOVEL + "e.g. "), plan), F.lit("ALREADY_HARD x"), F.concat(F.lit("  "), plan, F.lit(" ")), F.lit("Something else"), F.lit("unclassified")]
    return rows.withColumn("k", k).withColumn("description", F.get(F.array(*kinds), F.col("k") % 5))


@query(f"WITH {_CLUSTERS} SELECT source, strategy FROM y")
def clean_strategies(spark: SparkSession, d: str) -> DataFrame:
    return _descriptions(spark, d).select("source", examples.clean_description(F.col("description")).alias("strategy"))


@query(f"""WITH {_CLUSTERS}, r AS (SELECT * FROM y WHERE strategy <> '' AND strategy <> 'Something else'), o AS (SELECT strategy, k FROM r WHERE num_failed > 2),
b AS (SELECT 'plan  SRC0' AS strategy, -2 AS k UNION ALL SELECT 'Base ban', -1), u AS (SELECT * FROM b UNION ALL SELECT * FROM o),
f AS (SELECT lower(regexp_replace(trim(strategy), '{SQL_SPACE}', ' ', 'g')) AS key, arg_min(strategy, k) AS strategy, min(k) AS k FROM u GROUP BY 1)
SELECT strategy, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position FROM f""")
def ban_list(spark: SparkSession, d: str) -> DataFrame:
    rows = _descriptions(spark, d).withColumn("strategy", examples.clean_description(F.col("description"))).filter("strategy <> ''")
    rows = examples.without_tail(rows, "strategy", "something  ELSE")
    base = spark.createDataFrame([(0, "plan  SRC0"), (1, "Base ban")], "ord int, strategy string")
    return examples.ban_list(base, rows.filter("num_failed > 2").select(F.col("k").alias("ord"), "strategy"), "strategy")


@query(f"""WITH {_CLUSTERS}, i AS (SELECT source, d.doc_id, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS turn, c.num_failed FROM documents d
 JOIN labels l USING (doc_id) JOIN c USING (source) WHERE l.quality = 0)
SELECT doc_id, CAST(turn AS INTEGER) AS turn FROM i ORDER BY turn, num_failed DESC, source, doc_id LIMIT 12""")
def round_robin_shots(spark: SparkSession, d: str) -> DataFrame:
    failed = table(spark, d, "labels").filter("quality = 0").select("doc_id")
    rows = table(spark, d, "documents").select("doc_id", "source").join(failed, "doc_id")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("num_failed"))
    ranked = rows.join(F.broadcast(counts), "source").withColumn("__rank", F.struct(-F.col("num_failed"), F.col("source")))
    return examples.round_robin(ranked, "source", "__rank", "doc_id", 12).select("doc_id", "turn")


@query(f"""WITH d AS (SELECT doc_id AS ord, text AS question, trim(regexp_replace(lower(text), '{SQL_SPACE}', ' ', 'g')) AS key, coalesce(toxic, 0) = 1 AS shot FROM documents LEFT JOIN labels USING (doc_id))
SELECT CASE WHEN shot THEN 0 ELSE 1 END AS part, ord, question FROM d WHERE shot OR key NOT IN (SELECT key FROM d WHERE shot) ORDER BY part, ord LIMIT 200""")
def topped_up_shots(spark: SparkSession, d: str) -> DataFrame:
    """Toxic documents as shots, topped up to 200 with the others that say something else."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rows = docs.select(F.col("doc_id").alias("ord"), F.col("text").alias("question"), (F.coalesce("toxic", F.lit(0)) == 1).alias("shot"))
    return examples.topped_up(rows.filter("shot").drop("shot"), rows.filter("NOT shot").drop("shot"), "question", 200)


@query(f"""WITH {_CLUSTERS} SELECT source, CAST(row_number() OVER (ORDER BY CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END, k) AS INTEGER) AS place FROM c""")
def cluster_order(spark: SparkSession, d: str) -> DataFrame:
    """Seed clusters before new ones, each by number."""
    node = F.concat(F.when(F.col("k") % 2 == 0, "seed.").otherwise("new."), F.col("k").cast("string"))
    kind, number = F.substring_index(node, ".", 1), F.substring_index(node, ".", -1).cast("int")
    place = F.row_number().over(Window.orderBy(F.when(kind == "seed", 0).when(kind == "new", 1).otherwise(2), number))
    return _descriptions(spark, d).select("source", place.alias("place"))


@query(f"""WITH {_CLUSTERS} SELECT k % 4 AS seed, string_agg(n || '. ' || source, chr(10) ORDER BY n) AS menu
 FROM (SELECT k, source, row_number() OVER (PARTITION BY k % 4 ORDER BY k) AS n FROM c) GROUP BY 1""")
def menu_text(spark: SparkSession, d: str) -> DataFrame:
    grouped = _descriptions(spark, d).groupBy((F.col("k") % 4).alias("seed")).agg(F.array_sort(F.collect_list(F.struct("k", "source"))).alias("items"))
    return grouped.select("seed", text.numbered(F.col("items.source")).alias("menu"))


_HASH = "(('0x' || substr(md5('{salt}' || user_id), 1, 12))::BIGINT + 0.5) / 281474976710656"


@query(f"""WITH u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY {_HASH.format(salt='system')}) AS p FROM u),
e AS (SELECT i, name, n * share AS exact, floor(n * share) AS base, n FROM (VALUES (1, 'a', 0.5), (2, 'b', 0.3), (3, 'c', 0.2)) v(i, name, share) CROSS JOIN (SELECT count(*) AS n FROM u)),
c AS (SELECT i, name, base + CASE WHEN row_number() OVER (ORDER BY exact - base DESC, i) <= n - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM e),
z AS (SELECT name, k, sum(k) OVER (ORDER BY i) AS upto FROM c) SELECT user_id, name AS system FROM r JOIN z ON p > upto - k AND p <= upto""")
def split_by_system(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "events").select("user_id").distinct()
    systems = spark.sql("SELECT * FROM VALUES (1, 'a', 0.5D), (2, 'b', 0.3D), (3, 'c', NULL) AS t(ord, name, share)")
    keyed = seeds.withColumn("at", scalar.unit_hash("system", F.col("user_id")))
    return examples.dealt(keyed, ["at", "user_id"], examples.split_sizes(systems, seeds.count()), "system").drop("at")


@query(f"""WITH u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY {_HASH.format(salt='prompt')}) AS p, count(*) OVER () AS n FROM u)
SELECT user_id, CASE WHEN p <= round_even(n * 0.25, 0) THEN 'explore' ELSE 'exploit' END AS prompt FROM r""")
def split_by_prompt(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "events").select("user_id").distinct()
    n = seeds.count()
    explore = examples.explore_count(n, 0.25)
    sizes = spark.sql(f"SELECT * FROM VALUES (1, 'explore', {explore}), (2, 'exploit', {n - explore}) AS t(ord, name, size)")
    keyed = seeds.withColumn("at", scalar.unit_hash("prompt", F.col("user_id")))
    return examples.dealt(keyed, ["at", "user_id"], sizes, "prompt").drop("at")


@query(f"""WITH u AS (SELECT DISTINCT user_id FROM events) SELECT user_id FROM u ORDER BY {_HASH.format(salt='shuffle')} LIMIT 25""")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "events").select("user_id").distinct()
    return seeds.orderBy(scalar.unit_hash("shuffle", F.col("user_id"))).limit(25)


@query(f"""WITH u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, {_HASH.format(salt='side')} < 0.5 AS swapped FROM u""")
def side_order(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "events").select("user_id").distinct()
    return seeds.select("user_id", (scalar.unit_hash("side", F.col("user_id")) < 0.5).alias("swapped"))


# --- reviews ---

_REVIEW = """r AS (SELECT d.doc_id, d.text, l.quality, l.toxic, CASE WHEN l.toxic = 1 THEN 'new question ' || doc_id WHEN l.toxic = 0 THEN '  ' END AS proposed_question,
 CASE WHEN l.quality = 1 THEN 'new criterion' END AS proposed_vc, doc_id % 11 = 0 AS missing_rewrite FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    question = F.when(F.col("toxic") == 1, F.concat(F.lit("new question "), F.col("doc_id").cast("string"))).when(F.col("toxic") == 0, "  ")
    return docs.withColumns(
        {"proposed_question": question, "proposed_vc": F.when(F.col("quality") == 1, "new criterion"), "missing_rewrite": F.col("doc_id") % 11 == 0}
    )


_PLAN = """p AS (SELECT *, CASE WHEN missing_rewrite THEN 'missing_rewrite' WHEN toxic = 1 THEN 'question_rewrite' WHEN quality = 1 THEN 'criterion_only' ELSE 'missing_rewrite' END AS kind FROM r)"""


def _plans(rows: DataFrame) -> DataFrame:
    question, criterion = (F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in ("proposed_question", "proposed_vc"))
    kind = F.when(F.col("missing_rewrite") | (question.isNull() & criterion.isNull()), "missing_rewrite").when(question.isNotNull(), "question_rewrite").otherwise("criterion_only")
    return rows.withColumns({
        "kind": kind, "question": F.coalesce(question, "text"), "criterion": F.coalesce(criterion, F.lit("as written")),
        "question_changed": question.isNotNull(), "criterion_changed": criterion.isNotNull(),
    })


@query(f"""WITH {_REVIEW}, {_PLAN} SELECT doc_id, kind, CASE WHEN toxic = 1 THEN proposed_question ELSE text END AS question, coalesce(proposed_vc, 'as written') AS criterion,
 coalesce(toxic = 1, false) AS question_changed, coalesce(quality = 1, false) AS criterion_changed FROM p""")
def rejudge_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plans(_reviews(spark, d)).select("doc_id", "kind", "question", "criterion", "question_changed", "criterion_changed")


@query(f"""WITH {_REVIEW}, {_PLAN} SELECT kind, CASE WHEN quality = 1 AND toxic = 0 THEN 'now_passes' WHEN quality = 1 THEN 'failed_other_issues' ELSE 'still_fails' END AS outcome,
 count(*) AS n FROM p WHERE kind = 'criterion_only' OR kind = 'question_rewrite' GROUP BY 1, 2""")
def rejudge_summary(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators import review  # noqa: PLC0415

    rows = _plans(_reviews(spark, d)).filter(F.col("kind").isin("criterion_only", "question_rewrite"))
    good = F.col("quality") == 1
    verdict = F.when(good & (F.col("toxic") == 0), "PASSED").otherwise("FAILED")
    return rows.groupBy("kind", review.rejudge_outcome(verdict, good).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_REVIEW} SELECT count(*) AS checked, count(CASE WHEN quality = 1 THEN 1 END) AS kept, round(count(CASE WHEN quality = 1 THEN 1 END) / count(*), 4) AS keep_rate,
 count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS criteria_rewritten, count(CASE WHEN quality IS NULL THEN 1 END) AS errors FROM r""")
def verification_summary(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("quality").isNull(), "error").when(F.col("quality") == 0, "incorrect").when(F.col("toxic") == 1, "partly_correct").otherwise("correct")
    rows = _reviews(spark, d).select(label.alias("label"))
    kept = F.col("label").isin(*examples.KEEP_LABELS)
    return rows.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(kept).alias("kept"), F.round(F.count_if(kept) / F.count(F.lit(1)), 4).alias("keep_rate"),
        F.count_if(F.col("label") == "partly_correct").alias("criteria_rewritten"), F.count_if(F.col("label") == "error").alias("errors"),
    )


@query(f"""WITH {_REVIEW} SELECT CASE WHEN quality = 0 THEN 'criterion_satisfied' END AS skip_reason, 'REJECT' AS pair_verdict, 'reject' AS decision, 0.0::DOUBLE AS cost_usd, doc_id
 FROM r WHERE quality = 0""")
def skipped_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _reviews(spark, d).filter("quality = 0").select("doc_id", F.lit("criterion_satisfied").alias("skip_reason"))
    return rows.withColumns({"pair_verdict": F.lit("REJECT"), "decision": F.lit("reject"), "cost_usd": F.lit(0.0)})


_TERMS = """t AS (SELECT doc_id, i, term, CASE WHEN (doc_id + i) % 5 = 0 THEN NULL ELSE (doc_id * i) % 4 END AS hits FROM (
 SELECT doc_id, unnest(range(1, 4)) AS i, string_split(text, ' ')[unnest(range(1, 4))] AS term FROM documents) WHERE term IS NOT NULL)"""


@query(rf"""WITH {_TERMS} SELECT doc_id, string_agg(term, '|' ORDER BY i) AS zero FROM t WHERE hits < 1 AND len(list_filter(regexp_split_to_array(term, '{SQL_SPACE}'), lambda w: w <> '')) <= 4
 AND NOT regexp_matches(term, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])[A-Z]{{2,}}($|[^\p{{L}}\p{{M}}\p{{N}}_])|\p{{Nd}}') GROUP BY doc_id""")
def zero_hit_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms that may reject and that no paper has; a failed search (null hits) never counts."""
    from quarry.operators import review  # noqa: PLC0415

    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", " ", -1), 1, 3)).alias("i", "term"))
    i = F.col("i") + 1
    rows = rows.withColumn("hits", F.when((F.col("doc_id") + i) % 5 != 0, (F.col("doc_id") * i) % 4))
    zero = rows.filter(review.can_reject(F.col("term")) & F.col("hits").isNotNull() & (F.col("hits") < 1))
    listed = zero.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "term"))).alias("z"))
    return listed.select("doc_id", F.array_join("z.term", "|").alias("zero"))


@query(rf"""WITH {_TERMS} SELECT doc_id, string_agg('- "' || term || '": ' || CASE WHEN hits IS NULL THEN 'search failed' WHEN hits = 1 THEN '1 paper' ELSE hits || ' papers' END, chr(10) ORDER BY i) AS evidence
 FROM t GROUP BY doc_id""")
def phrase_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", " ", -1), 1, 3)).alias("i", "term"))
    i = F.col("i") + 1
    hits = F.when((F.col("doc_id") + i) % 5 != 0, (F.col("doc_id") * i) % 4)
    found = F.when(hits.isNull(), "search failed").when(hits == 1, "1 paper").otherwise(F.concat(hits.cast("string"), F.lit(" papers")))
    line = F.concat(F.lit('- "'), F.col("term"), F.lit('": '), found)
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("l"))
    return grouped.select("doc_id", F.array_join("l.line", "\n").alias("evidence"))


@query("""SELECT source, lang AS target, coalesce(CAST(quality AS VARCHAR), 'None') AS kind, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2, 3""")
def benchmark_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    kind = F.coalesce(F.col("quality").cast("string"), F.lit("None"))
    return rows.groupBy("source", F.col("lang").alias("target"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS modal FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM m) WHERE r = 1""")
def modal_value(spark: SparkSession, d: str) -> DataFrame:
    """The most common value, of equals the one seen first."""
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return counts.groupBy("user_id").agg(F.max_by("event_type", F.struct(F.col("n"), -F.col("first"))).alias("modal"))


@query("""SELECT lang AS target, system, count(verdict) AS answered, count(CASE WHEN verdict = 'FAILED' THEN 1 END) AS failed, count(*) AS asked FROM (SELECT lang, system,
 CASE WHEN system = 'quality' THEN CASE quality WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PASSED' END ELSE CASE toxic WHEN 1 THEN 'FAILED' WHEN 0 THEN 'PASSED' END END AS verdict
 FROM documents LEFT JOIN labels USING (doc_id) CROSS JOIN (SELECT unnest(['quality', 'toxic']) AS system)) GROUP BY 1, 2""")
def verdicts_by_target(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("target")).join(table(spark, d, "labels"), "doc_id", "left")
    quality = F.when(F.col("quality") == 0, "FAILED").when(F.col("quality") == 1, "PASSED")
    toxic = F.when(F.col("toxic") == 1, "FAILED").when(F.col("toxic") == 0, "PASSED")
    verdicts = F.array(F.struct(F.lit("quality").alias("system"), quality.alias("verdict")), F.struct(F.lit("toxic").alias("system"), toxic.alias("verdict")))
    each = rows.select("target", F.inline(verdicts))
    return each.groupBy("target", "system").agg(
        F.count("verdict").alias("answered"), F.count_if(F.col("verdict") == "FAILED").alias("failed"), F.count(F.lit(1)).alias("asked")
    )


@query("""SELECT doc_id, 'samples/' || replace(source || '/' || doc_id, '/', '__') || '.json' AS file, CASE quality WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PASSED' END AS quality,
 CASE toxic WHEN 1 THEN 'FAILED' WHEN 0 THEN 'PASSED' END AS toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    """Index rows of nested records: a file name, and each system's verdict out of a map of judgments."""
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    quality = F.when(F.col("quality") == 0, "FAILED").when(F.col("quality") == 1, "PASSED")
    toxic = F.when(F.col("toxic") == 1, "FAILED").when(F.col("toxic") == 0, "PASSED")
    systems = F.create_map(*[x for name, v in (("quality", quality), ("toxic", toxic)) for x in (F.lit(name), F.struct(F.struct(v.alias("verdict")).alias("judgment")))])
    verdicts = F.transform_values(systems, lambda _, v: v["judgment"]["verdict"])
    name = text.file_name(F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return rows.select("doc_id", F.concat(F.lit("samples/"), name).alias("file"), verdicts["quality"].alias("quality"), verdicts["toxic"].alias("toxic"))
