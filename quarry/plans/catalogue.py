"""Registered queries over the driver's tables, and the same in SQL.

Concepts stand on the tables as follows: question text = documents.text, system =
documents.lang, strategy cluster = documents.source, verdict = labels.quality, attempt log
= events, chat trace = conversations, passage = lineitem, paper = orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.operators import clusters, dedup, examples, loops, positions, retrieval, review, traces
from quarry.plans.registry import ORACLE_SQL, QUERIES, SQL_SPACE, query, table
from quarry.storage import materialize
from quarry.streaming import call_log


def _examples(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return docs.join(table(spark, d, "labels"), "doc_id").withColumn("failed", F.col("quality") == 0)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    spine = table(spark, d, "documents").select("source").distinct()
    return clusters.nodes(_examples(spark, d), spine, "source", "failed")


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return retrieval.attempt_numbers(events, "user_id", ["ts", "event_id"])


_NODES = """examples AS (SELECT d.doc_id, d.source, d.lang, l.quality, l.quality = 0 AS failed FROM documents d JOIN labels l USING (doc_id)),
spine AS (SELECT DISTINCT source FROM documents),
nodes AS (SELECT s.source, count(e.doc_id) AS num_questions, count(CASE WHEN e.failed THEN 1 END) AS num_failed
 FROM spine s LEFT JOIN examples e ON e.source = s.source GROUP BY s.source),
scored AS (SELECT *, CASE WHEN num_questions > 0 THEN num_failed / num_questions ELSE 0.0 END AS failure_rate,
 num_questions / sum(num_questions) OVER () AS share FROM nodes),
ranked AS (SELECT source, num_questions, num_failed, failure_rate, share,
 CASE WHEN num_questions > 0 THEN failure_rate * (1 - share) ELSE 0.0 END AS score,
 greatest((num_failed + 1) / (num_questions + 2) * (1 - share), 1e-9) AS weight FROM scored)"""

_RANKING = f"""WITH {_NODES} SELECT source, num_questions, num_failed, failure_rate, share, score, weight,
 CAST(row_number() OVER (ORDER BY {{order}}, source) AS INTEGER) AS rank FROM ranked"""


def _ranking(spark: SparkSession, d: str, by: str) -> DataFrame:
    return clusters.rank(_nodes(spark, d), "source", by).select(
        "source", "num_questions", "num_failed", "failure_rate", "share", "score", "weight", "rank"
    )


@query(_RANKING.format(order="score DESC, failure_rate DESC, share ASC"))
def strategy_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d, "underrepresented")


@query(_RANKING.format(order="failure_rate DESC, share ASC, num_failed DESC"))
def ranking_by_failure_rate(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d, "failure_rate")


@query(_RANKING.format(order="num_failed DESC, failure_rate DESC"))
def ranking_by_volume(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d, "volume")


@query(f"""WITH RECURSIVE {_NODES}, r AS (SELECT source, row_number() OVER (ORDER BY failure_rate DESC, num_failed DESC, source) AS a,
 row_number() OVER (ORDER BY num_failed DESC, failure_rate DESC, source) AS b FROM scored),
lists AS (SELECT list(source ORDER BY a) AS a, list(source ORDER BY b) AS b FROM r),
drawn(taken) AS (SELECT CAST([] AS VARCHAR[]) UNION ALL SELECT list_append(taken, list_filter(CASE WHEN len(taken) % 2 = 0 THEN a ELSE b END, lambda x: NOT list_contains(taken, x))[1])
 FROM drawn, lists WHERE len(taken) < len(a))
SELECT taken[i] AS source, CAST(i AS INTEGER) AS rank FROM (SELECT taken, unnest(range(1, len(taken) + 1)) AS i FROM drawn, lists WHERE len(taken) = len(a))""")
def ranking_diverse(spark: SparkSession, d: str) -> DataFrame:
    return examples.diverse(_nodes(spark, d), "source")


@query(f"""WITH {_NODES} SELECT source, lang AS source_run, count(*) AS num_questions,
 count(CASE WHEN failed THEN 1 END) AS num_failed FROM examples GROUP BY source, lang""")
def source_run_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return clusters.run_breakdown(_examples(spark, d), "source", "lang", "failed")


@query(f"WITH {_NODES} SELECT source, num_failed FROM nodes WHERE num_failed > 3")
def ban_quota(spark: SparkSession, d: str) -> DataFrame:
    return clusters.over_quota(_nodes(spark, d), 3).select("source", "num_failed")


@query(f"WITH {_NODES} SELECT source, weight FROM ranked WHERE num_failed <= 3")
def example_pool(spark: SparkSession, d: str) -> DataFrame:
    ranked = clusters.rank(_nodes(spark, d), "source")
    return ranked.join(clusters.over_quota(ranked, 3).select("source"), "source", "left_anti").select("source", "weight")


@query(f"""WITH {_NODES} SELECT source, doc_id, place FROM (SELECT source, doc_id,
 CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS place FROM examples WHERE failed) WHERE place <= 3""")
def few_shot_top_n(spark: SparkSession, d: str) -> DataFrame:
    return clusters.first_failures(_examples(spark, d), "source", "doc_id", "failed", 3).select("source", "doc_id", "place")


@query("""WITH u AS (SELECT seed, item, weight, (('0x' || substr(md5('menu' || seed || '|' || item), 1, 12))::BIGINT + 0.5) / 281474976710656 AS u
 FROM (SELECT DISTINCT lang AS seed FROM documents) CROSS JOIN (SELECT source AS item, CAST(count(*) AS DOUBLE) AS weight FROM documents GROUP BY source))
SELECT seed, item, place FROM (SELECT seed, item, CAST(row_number() OVER (PARTITION BY seed ORDER BY ln(u) / weight DESC, item) AS INTEGER) AS place FROM u) WHERE place <= 6""")
def weighted_menu(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    seeds = docs.select(F.col("lang").alias("seed")).distinct()
    pool = docs.groupBy(F.col("source").alias("item")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return clusters.weighted_menus(seeds, pool, "seed", "item", "weight", 6, "menu").select("seed", "item", "place")


_STRATA = """s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT *, 100 * n / sum(n) OVER () AS exact FROM s),
a AS (SELECT lang, n, CAST(floor(exact) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, lang) <= 100 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS allocated FROM e)"""


def _allocation(spark: SparkSession, d: str) -> DataFrame:
    return clusters.allocate(table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "n", 100)


@query(f"WITH {_STRATA} SELECT lang, n, CAST(allocated AS BIGINT) AS allocated FROM a")
def stratified_allocation(spark: SparkSession, d: str) -> DataFrame:
    return _allocation(spark, d)


@query(f"""WITH {_STRATA}, p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY
 (('0x' || substr(md5('subset' || doc_id), 1, 12))::BIGINT + 0.5) / 281474976710656, doc_id) AS place FROM documents)
SELECT doc_id, lang FROM p JOIN a USING (lang) WHERE place <= allocated""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return clusters.stratified_sample(docs, _allocation(spark, d), "lang", "doc_id", "subset").select("doc_id", "lang")


@query("""SELECT event_type, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, round(sum(value), 4) AS cost FROM events GROUP BY event_type""")
def round_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.sum("value"), 4).alias("cost")
    )


@query("""SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, count(CASE WHEN quality = 0 THEN 1 END) AS failed
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (lang, source))""")
def cell_stats(spark: SparkSession, d: str) -> DataFrame:
    rolled = _examples(spark, d).groupingSets([["lang"], ["lang", "source"]], "lang", "source")
    return rolled.agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed")).na.fill("all", ["lang", "source"])


_ATTEMPTS = """a AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) - 1 AS attempt,
 count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


@query(f"""WITH {_ATTEMPTS}, b AS (SELECT user_id, min(attempt) AS attempts FROM a WHERE event_type = 'error' GROUP BY user_id)
SELECT attempts, count(*) AS seeds FROM b GROUP BY attempts""")
def attempts_to_break(spark: SparkSession, d: str) -> DataFrame:
    broken = _attempts(spark, d).filter("event_type = 'error'").groupBy("user_id").agg(F.min("attempt").alias("attempts"))
    return broken.groupBy("attempts").agg(F.count(F.lit(1)).alias("seeds"))


@query(f"WITH {_ATTEMPTS} SELECT user_id, event_id, event_type, attempt FROM a WHERE attempt = n - 1")
def deciding_attempt(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    counted = events.groupBy("user_id").agg(
        F.max(F.struct("ts", "event_id", "event_type")).alias("last"), (F.count(F.lit(1)) - 1).cast("int").alias("attempt")
    )
    return counted.select("user_id", "last.event_id", "last.event_type", "attempt")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_wins(table(spark, d, "documents").select("doc_id", "text"), ["text"], [F.col("doc_id")])


@query(f"""SELECT trim(regexp_replace(lower(text), '{SQL_SPACE}', ' ', 'g')) AS norm, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING norm <> ''""")
def norm_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", scalar.norm(F.col("text")).alias("norm")).filter("norm <> ''")
    return dedup.first_wins(rows, ["norm"], [F.col("doc_id")]).select("norm", "doc_id")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
 ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_wins_success_beats_error(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return dedup.latest_wins(events, ["user_id"], F.col("event_type") == "error", F.col("event_id"))


@query("SELECT source, min(doc_id) AS position, max(doc_id) AS latest FROM documents GROUP BY source")
def order_preserving_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", F.col("doc_id").alias("latest"))
    return dedup.keyed_merge(rows, "source", "doc_id", F.col("latest")).select("source", "position", "latest")


_WORDS = "len(list_filter(regexp_split_to_array({x}, '" + SQL_SPACE.replace("{", "{{").replace("}", "}}") + "'), lambda w: w <> ''))"


@query(f"SELECT doc_id, CAST({_WORDS.format(x='text')} AS INTEGER) AS n_words FROM documents WHERE {_WORDS.format(x='text')} <= 200")
def max_words_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", scalar.word_count(F.col("text")).alias("n_words"))
    return rows.filter("n_words <= 200")


@query("SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) > 20")
def passage_min_len(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(scalar.space_pieces(F.col("text")) > 20).select("doc_id")


@query("""WITH u AS (SELECT text, min(doc_id) AS doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY text)
SELECT doc_id, ord FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS ord FROM u) WHERE ord BETWEEN 11 AND 60""")
def usable_window(spark: SparkSession, d: str) -> DataFrame:
    usable = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    unique = dedup.first_wins(table(spark, d, "documents").select("doc_id", "text").join(usable, "doc_id"), ["text"], [F.col("doc_id")])
    # The slice ends at 60, so the top 60 are found in every task before any is moved.
    head = unique.select("doc_id").orderBy("doc_id").limit(60)
    return head.withColumn("ord", F.row_number().over(Window.orderBy("doc_id"))).filter("ord > 10")


@query(f"""SELECT doc_id, CASE WHEN quality = 1 THEN 'criterion_satisfied' WHEN {_WORDS.format(x='text')} > 300 THEN 'too_long' END AS skip_reason
FROM documents LEFT JOIN labels USING (doc_id)""")
def skip_reason(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", review.skip_reason(F.col("quality") == 1, F.col("text"), 300).alias("skip_reason"))


@query(f"""SELECT item_id, term, {_WORDS.format(x='term')} <= 4 AND NOT regexp_matches(term, '\\b[A-Z]{{2,}}\\b|[0-9]') AS can_reject
FROM (SELECT item_id, array_to_string(string_split(text, ' ')[1:item_id % 7 + 1], ' ') AS term FROM benchmark)""")
def term_can_reject(spark: SparkSession, d: str) -> DataFrame:
    pieces = F.slice(F.split("text", " ", -1), F.lit(1), (F.col("item_id") % 7 + 1).cast("int"))
    rows = table(spark, d, "benchmark").select("item_id", F.array_join(pieces, " ").alias("term"))
    return rows.withColumn("can_reject", review.can_reject(F.col("term")))


_VERDICTS = "CASE WHEN quality = 1 THEN 'PASS' ELSE 'MINOR_REVISION' END"


@query(f"""SELECT doc_id, CASE WHEN toxic = 1 THEN 'REJECT' WHEN quality = 1 THEN 'PASS' ELSE 'MINOR_REVISION' END AS decision FROM labels""")
def pair_decision(spark: SparkSession, d: str) -> DataFrame:
    question = F.when(F.col("quality") == 1, "PASS").otherwise("MINOR_REVISION")
    criterion = F.when(F.col("toxic") == 1, "REJECT").otherwise("PASS")
    return table(spark, d, "labels").select("doc_id", scalar.worst_severity(question, criterion).alias("decision"))


@query("""SELECT coalesce(lang, 'None') AS "key", coalesce(CAST(quality AS VARCHAR), 'open') AS decision, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def review_crosstab(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return review.crosstab(rows.withColumn("decision", F.coalesce(F.col("quality").cast("string"), F.lit("open"))), "lang", "decision")


@query("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'now_passes' WHEN quality = 1 THEN 'failed_other_issues' ELSE 'still_fails' END AS outcome FROM labels""")
def rejudge_outcome(spark: SparkSession, d: str) -> DataFrame:
    good = F.col("quality") == 1
    verdict = F.when(good & (F.col("toxic") == 0), "PASSED").otherwise("FAILED")
    return table(spark, d, "labels").select("doc_id", review.rejudge_outcome(verdict, good).alias("outcome"))


@query("""SELECT doc_id, 'pass' AS source FROM labels WHERE quality = 1 AND toxic = 0 UNION ALL SELECT doc_id, 'rejudged' FROM labels WHERE quality = 0""")
def benchmark_union(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    kept = labels.filter("quality = 1 AND toxic = 0").select("doc_id", F.lit("pass").alias("source"))
    return kept.unionByName(labels.filter("quality = 0").select("doc_id", F.lit("rejudged").alias("source")))


@query("""SELECT d.doc_id, d.source, l.quality, b.text AS item FROM documents d JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def export_join(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("item"))
    joined = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").join(items, "doc_id", "left")
    return joined.select("doc_id", "source", "quality", "item")


@query("""SELECT d.doc_id AS id, s.system FROM documents d CROSS JOIN (SELECT DISTINCT lang AS system FROM documents) s
WHERE s.system <> d.lang AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND s.system = 'en')""")
def cross_system_fill(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("target"))
    systems = docs.select(F.col("target").alias("system")).distinct()
    judged = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("en").alias("system"))
    return review.open_slots(docs, systems, judged)


_LONG = """v AS (SELECT doc_id AS id, lang AS target, system, CASE WHEN system = 'quality' THEN (CASE WHEN quality = 0 THEN 'FAILED' WHEN quality = 1 THEN 'PASSED' END)
 ELSE (CASE WHEN toxic = 1 THEN 'FAILED' WHEN toxic = 0 THEN 'PASSED' END) END AS verdict
 FROM (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) x
 CROSS JOIN (SELECT unnest(['quality', 'toxic', 'en']) AS system) s)"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("target"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    rows = docs.join(labels, "id", "left")
    toxic = F.when(F.col("toxic") == 1, "FAILED").when(F.col("toxic") == 0, "PASSED")
    quality = F.when(F.col("quality") == 0, "FAILED").when(F.col("quality") == 1, "PASSED")
    return rows.withColumn("system", F.explode(F.array(F.lit("quality"), F.lit("toxic"), F.lit("en")))).select(
        "id", "target", "system", F.when(F.col("system") == "quality", quality).otherwise(toxic).alias("verdict")
    )


@query(f"""WITH {_LONG} SELECT system, count(verdict) AS judged, count(CASE WHEN verdict = 'FAILED' THEN 1 END) AS failed,
 count(CASE WHEN verdict = 'PASSED' THEN 1 END) AS passed, count(CASE WHEN verdict = 'FAILED' THEN 1 END) / count(verdict) AS fail_rate
FROM v WHERE system <> target GROUP BY system""")
def cross_system_summary(spark: SparkSession, d: str) -> DataFrame:
    return review.system_summary(_verdicts(spark, d))


_FULL = f"""WITH {_LONG}, f AS (SELECT system FROM v GROUP BY system HAVING count(verdict) * 2 >= (SELECT count(*) FROM labels))
SELECT id, bool_and({{fails}}) AS failed_by_all FROM v JOIN f USING (system) GROUP BY id"""


@query(_FULL.format(fails="coalesce(verdict = 'FAILED', false)"))
def failed_by_all(spark: SparkSession, d: str) -> DataFrame:
    return review.failed_by_all(_verdicts(spark, d), table(spark, d, "labels").count())


@query(_FULL.format(fails="coalesce(verdict = 'FAILED', true)"))
def failed_by_all_missing_fails(spark: SparkSession, d: str) -> DataFrame:
    return review.failed_by_all(_verdicts(spark, d), table(spark, d, "labels").count(), missing_fails=True)


@query("""SELECT l_orderkey, max(l_extendedprice) AS best_score, count(*) AS n_passages, min(l_linenumber) AS first_passage
FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) GROUP BY l_orderkey ORDER BY best_score DESC, first_passage, l_orderkey LIMIT 50""")
def passage_to_paper(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.papers(
        table(spark, d, "lineitem"), table(spark, d, "orders"), "l_orderkey", "o_orderkey", "l_extendedprice", "l_linenumber", 50
    )


@query("""WITH f AS (SELECT l_partkey, min(l_linenumber) AS q FROM lineitem GROUP BY l_partkey)
SELECT l.l_orderkey, l.l_partkey, l.l_linenumber FROM lineitem l JOIN f ON f.l_partkey = l.l_partkey AND f.q = l.l_linenumber
WHERE l.l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)""")
def extra_query_dedup(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    base = table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("l_partkey"))
    return retrieval.fresh_by_query(hits, base, "l_partkey", "l_linenumber").select("l_orderkey", "l_partkey", "l_linenumber")


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS stitched FROM conversations GROUP BY conv_id""")
def section_stitch(spark: SparkSession, d: str) -> DataFrame:
    turn = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    grouped = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.array_join("turns.line", "\n").alias("stitched"))


@query("""SELECT o_orderstatus, min(year(o_orderdate)) AS min_year, max(year(o_orderdate)) AS max_year, round(avg(year(o_orderdate)), 1) AS avg_year,
 round(100.0 * count(CASE WHEN year(o_orderdate) >= 1993 THEN 1 END) / count(*), 2) AS pct_recent, count(DISTINCT o_orderpriority) AS n_fields FROM orders GROUP BY o_orderstatus""")
def paper_signals(spark: SparkSession, d: str) -> DataFrame:
    year = F.year("o_orderdate")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.min(year).alias("min_year"),
        F.max(year).alias("max_year"),
        F.round(F.avg(year), 1).alias("avg_year"),
        F.round(100.0 * F.count_if(year >= 1993) / F.count(F.lit(1)), 2).alias("pct_recent"),
        F.countDistinct("o_orderpriority").alias("n_fields"),
    )


_COSINE = """1 - list_sum(list_transform(list_zip(a, b), lambda x: CAST(x[1] AS DOUBLE) * x[2])) / (sqrt(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE) * x)))
 * sqrt(list_sum(list_transform(b, lambda x: CAST(x AS DOUBLE) * x))))"""


@query(f"""WITH p AS (SELECT e.vec_id, s.vec_id AS seed, round({_COSINE}, 6) + 0.0 AS distance FROM (SELECT vec_id, embedding AS a FROM embeddings) e
 CROSS JOIN (SELECT vec_id, embedding AS b FROM embeddings WHERE vec_id < 10) s)
SELECT vec_id, min(distance) AS distance FROM p GROUP BY vec_id""")
def nearest_seed(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    seeds = vectors.filter("vec_id < 10").select(F.col("vec_id").alias("seed_id"), "embedding")
    found = retrieval.nearest_seed(vectors, seeds, "vec_id", "embedding", "seed_id")
    return found.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query()
def online_clusters(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.online_clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.35)


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), t AS (SELECT count(*) AS total FROM part)
SELECT p_brand, round((total + 1) / (exp(ln(greatest(n, 1))) + 1), 6) AS rarity FROM c CROSS JOIN t""")
def rarity_ratio(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    total = parts.agg(F.count(F.lit(1)).alias("total"))
    counts = parts.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
    ratio = (F.col("total") + 1) / (F.exp(F.ln(F.greatest("n", F.lit(1)))) + 1)
    return counts.select("p_brand", F.round(ratio, 6).alias("rarity"))


@query("""SELECT l_returnflag AS model, round(sum((l_quantity * r.rin + l_linenumber * r.rout + l_suppkey * r.rin * 0.10) / 1e6), 6) AS cost_usd
FROM (SELECT l_returnflag, l_quantity, l_linenumber, l_suppkey, coalesce(p.rin, 0) AS rin, coalesce(p.rout, 0) AS rout FROM lineitem
 LEFT JOIN (VALUES ('A', 3.0, 15.0), ('N', 1.0, 5.0)) p(model, rin, rout) ON p.model = l_returnflag) r GROUP BY l_returnflag""")
def cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    rates = F.broadcast(spark.createDataFrame([("A", 3.0, 15.0), ("N", 1.0, 5.0)], "model string, rin double, rout double"))
    rows = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "model").join(rates, "model", "left").na.fill(0.0, ["rin", "rout"])
    usage = {"input": F.col("l_quantity"), "output": F.col("l_linenumber"), "cache_read": F.col("l_suppkey")}
    cost = scalar.token_cost(usage, F.col("rin"), F.col("rout"))
    return rows.groupBy("model").agg(F.round(F.sum(cost), 6).alias("cost_usd"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def work_list(spark: SparkSession, d: str) -> DataFrame:
    return dedup.work_list(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_REST = r"regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"


@query(rf"""SELECT page_id, lower(regexp_extract(r, '^([^/?]*)', 1)) || regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', '') || regexp_extract(r, '(\?.*)$', 1) AS url_key
FROM (SELECT page_id, {_REST} AS r FROM pages)""")
def url_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", scalar.url_key(F.col("url")).alias("url_key"))


@query(f"""SELECT inside, count(*) AS n, count(DISTINCT host) AS hosts FROM (SELECT host, host IN ('example.com', 'example.org') OR host LIKE '%.example.com' OR host LIKE '%.example.org' AS inside
FROM (SELECT {_HOST} AS host FROM pages)) GROUP BY inside""")
def domain_audit(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "pages").select(scalar.url_host(F.col("url")).alias("host"))
    inside = hosts.withColumn("inside", scalar.in_domains(F.col("host"), ["example.com", "example.org"]))
    return inside.groupBy("inside").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("host").alias("hosts"))


@query("""SELECT conv_id, count(*) AS turns, count(CASE WHEN role = 'assistant' THEN 1 END) AS answers, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def trace_tool_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max("turn").alias("last_turn")
    )


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), f AS (SELECT host, min(page_id) AS first FROM h GROUP BY host)
SELECT page_id, CAST(dense_rank() OVER (ORDER BY first) AS INTEGER) AS number FROM h JOIN f USING (host)""")
def citation_numbering(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", scalar.url_host(F.col("url")).alias("host"))
    first = pages.groupBy("host").agg(F.min("page_id").alias("first"))
    placed = positions.numbered(first, ["first"], "number").select(F.col("host").alias("__h"), (F.col("number") + 1).cast("int").alias("number"))
    return pages.join(placed, F.col("host").eqNullSafe(F.col("__h"))).select("page_id", "number")


@query("""SELECT event_id, round(CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END, 6) AS advantage FROM events
JOIN (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY user_id) USING (user_id)""")
def group_normalised_reward(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "value")
    return retrieval.group_normalised(rows, "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("""SELECT doc_id, 'quarry' AS data_source, '[{"role":"user","content":' || to_json(text) || '}]' AS prompt, 'research' AS ability FROM documents""")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    chat = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    return table(spark, d, "documents").select(
        "doc_id", F.lit("quarry").alias("data_source"), chat.alias("prompt"), F.lit("research").alias("ability")
    )


@query("""WITH m AS (SELECT DISTINCT doc_id // 250 AS round, source FROM documents JOIN labels USING (doc_id) WHERE quality = 0)
SELECT coalesce(a.round, b.round + 1) AS round, coalesce(a.source, b.source) AS source, CASE WHEN b.source IS NULL THEN 'added' ELSE 'dropped' END AS change
FROM m a FULL JOIN m b ON a.round = b.round + 1 AND a.source = b.source WHERE a.source IS NULL OR b.source IS NULL""")
def menu_diff(spark: SparkSession, d: str) -> DataFrame:
    menu = _examples(spark, d).filter("failed").select(F.expr("doc_id div 250").alias("round"), "source").distinct()
    before = menu.select((F.col("round") + 1).alias("round"), "source", F.lit(1).alias("was"))
    both = menu.withColumn("now", F.lit(1)).join(before, ["round", "source"], "full").filter("now IS NULL OR was IS NULL")
    return both.select("round", "source", F.when(F.col("was").isNull(), "added").otherwise("dropped").alias("change"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT quality, round(avg(n_chars), 4) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def hard_easy_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("quality").agg(F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query(f"""WITH {_ATTEMPTS}, s AS (SELECT user_id, min(CASE WHEN event_type = 'error' THEN attempt END) AS broke, max(n) AS n FROM a GROUP BY user_id)
SELECT user_id, CASE WHEN broke = 0 THEN 'ALREADY_HARD' WHEN broke <= 5 THEN 'FAILED_FOUND' WHEN n > 5 THEN 'EXHAUSTED' ELSE 'ERROR' END AS status,
CAST(CASE WHEN broke <= 5 THEN broke WHEN n > 5 THEN 5 ELSE n END AS INTEGER) AS attempts FROM s""")
def attempt_statuses(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("event_type") == "error", "FAILED").otherwise("PASSED")
    # Numbered once: every attempt reads the written table.
    events = materialize(_attempts(spark, d).select("user_id", "attempt", verdict.alias("verdict")), "attempts")

    def attempt(open_seeds: DataFrame, n: int) -> DataFrame:
        return events.filter(F.col("attempt") == n).join(open_seeds, "user_id", "left_semi")

    return loops.attempt_loop(events.select("user_id").distinct(), "user_id", attempt, 5)


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS calls,
count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, round(sum(value), 4) AS cost FROM events GROUP BY 1, 2""")
def streaming_spend(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    stream = call_log.read_calls(spark, d, schema, "events.parquet")
    spent = call_log.spend(stream, "ts", "event_type", "value", F.col("event_type") == "error", "1 hour")
    out = call_log.run_available(spent, ["window_start", "event_type"])
    return out.withColumns({"window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), "cost": F.round("cost", 4)})


@query("""WITH k AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS position,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY value <= 50, event_id) AS place FROM events)
SELECT position, user_id, event_id, event_type FROM k WHERE place = 1""")
def selected_refs(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", (F.col("value") > 50).alias("backref"))
    refs = events.withColumn("title", F.lit(None).cast("string"))
    return traces.selected_refs(refs, "user_id", "event_id", "event_type", "title", "backref").drop("backref", "title")


from quarry.plans import checks, literature, loop, outer, providers, replay, reports  # noqa: E402, F401 - they register their queries
