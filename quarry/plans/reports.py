"""Queries over explorer sources, judge texts, report joins, menus' parts and benchmark records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.functions import text as texts
from quarry.operators import answers, clusters, examples, explorer, reports, review
from quarry.plans.loop import _CLUSTERS, _descriptions
from quarry.plans.registry import SQL_SPACE, query, table


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, turn % 4 AS kind FROM conversations),
p AS (SELECT conv_id, turn, kind, text, unnest([1, 2, 3]) AS page, 'http://s/' || turn || '/' || page AS url FROM c)
SELECT conv_id, turn, CAST(page - 1 AS INTEGER) AS place, page::VARCHAR AS page, CASE page WHEN 2 THEN '(untitled)' ELSE 'T' || page END AS title, url,
 md5(CASE WHEN page = 1 AND kind = 0 THEN left(repeat('page ', 300) || text, 2000) WHEN page = 3 AND kind IN (0, 3) THEN 'blurb 3 ' || left(text, 30) ELSE 'blurb ' || page || ' ' || left(text, 30) END) AS snippet_md5,
 CASE kind WHEN 0 THEN page IN (1, 3) WHEN 3 THEN page IN (2, 3) ELSE false END AS backref,
 CASE kind WHEN 0 THEN page IN (1, 3) WHEN 3 THEN page IN (2, 3) ELSE true END AS selected FROM p""")
def explorer_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of explorer calls, a call a turn: four blocks, one of them broken, and texts that refer back to some or none."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))

    def block(page: int, title: str, fetched: Column) -> Column:
        doc = F.to_json(F.struct(F.lit(title).alias("title"), _join("http://s/", F.col("turn"), f"/{page}").alias("url"), _join(f"blurb {page} ", F.left("text", F.lit(30))).alias("snippet"), fetched.alias("page_info")))
        return F.concat(F.lit(f"***Web Page {page}:***\n"), F.left(doc, F.length(doc) - 1), F.lit("\n}\n"))

    page = F.concat(F.lit("page " * 300), "text")
    given = F.concat(block(1, "T1", page), block(2, "", F.lit("")), block(3, "T3", F.lit("")), F.lit("***Web Page 4:***\n{broken\n}\n"))
    kind = F.col("turn") % 4
    said = F.when(kind == 0, "see Web Pages 1 and 3.").when(kind == 1, "Web Page 9 says 2 things").when(kind == 3, "web pages 2-4").otherwise("")
    calls = turns.select("conv_id", "turn", given.alias("input"), said.alias("extracted"), F.lit("q").alias("search_query"))
    found = explorer.explorer_sources(calls, "conv_id", "turn")
    return found.select("conv_id", "turn", "place", "page", "title", "url", F.md5("snippet").alias("snippet_md5"), "backref", "selected")


@query(f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{SQL_SPACE}'), lambda w: w <> '') AS ws FROM conversations),
r AS (SELECT *, CASE WHEN len(ws) > 0 THEN chr(10) || '    snippet: ' || array_to_string(ws[1:8], ' ') || CASE WHEN len(ws) > 8 THEN ' …' ELSE '' END ELSE '' END AS s FROM t)
SELECT conv_id, turn, turn % 2 = 0 AS inline, CASE WHEN turn % 2 = 0 THEN text || ' [1] tail' || chr(10) || chr(10) || 'References' || chr(10) || '[1] T' || turn || ' — http://b/' || turn || s
 ELSE text || chr(10) || chr(10) || 'SOURCES (retrieved while researching; not claim-level citations)' || chr(10) || '[1] (untitled)' || s END AS told FROM r""")
def judge_texts(spark: SparkSession, d: str) -> DataFrame:
    """Answers as a judge reads them: numbered citations with references, or sources that no claim cites."""
    turns = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    even = F.col("turn") % 2 == 0

    def document(id_: str, title: Column, url: Column) -> Column:
        return F.struct(F.lit(id_).alias("id"), title.alias("title"), url.alias("url"), F.col("text").alias("snippet"))

    documents = F.array(document("a-0", F.lit(""), F.lit("")), document("b-0", _join("T", F.col("turn")), _join("http://b/", F.col("turn"))))
    answer = F.when(even, F.concat(F.lit('<cite id="b-0, gone">'), "text", F.lit("</cite> tail"))).otherwise(F.col("text"))
    told = explorer.judge_text(answer, documents, F.slice(documents, 1, 1), 8)
    return turns.select("conv_id", "turn", told.alias("t")).select("conv_id", "turn", "t.inline", F.col("t.text").alias("told"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Given ' || page_id WHEN 1 THEN 'First ' || page_id WHEN 2 THEN CASE WHEN page_id % 3 = 0 THEN 'Second ' || page_id ELSE 'paper.pdf' END ELSE url END AS title,
 CASE page_id % 4 WHEN 1 THEN 'first' WHEN 2 THEN CASE WHEN page_id % 3 = 0 THEN 'second' ELSE 'api' END ELSE 'api' END AS title_source FROM pages""")
def repaired_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of pages; unusable ones from a first table, or else a second."""
    pages, n = table(spark, d, "pages").select("page_id", "url"), F.col("page_id")
    given = F.when(n % 4 == 0, _join("Given ", n)).when(n % 4 == 1, "Microsoft Word - x").when(n % 4 == 2, "paper.pdf").otherwise(F.col("url"))
    first = pages.filter(n % 4 < 2).select("page_id", _join("First ", n).alias("title"))
    second = pages.filter((n % 4 != 3) & (n % 3 == 0)).select("page_id", _join("Second ", n).alias("title"))
    return explorer.titled(pages.select("page_id", given.alias("title")), first, second, "page_id")


@query("""WITH s AS (SELECT md5(coalesce(text, '')) AS key, min(doc_id) AS entry FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1 UNION ALL SELECT source, min(doc_id) FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT d.doc_id, coalesce(a.entry, b.entry) AS entry FROM documents d LEFT JOIN s a ON a.key = md5(coalesce(text, '')) LEFT JOIN s b ON b.key = d.source""")
def linked_questions(spark: SparkSession, d: str) -> DataFrame:
    """Each question's sample by its text, or else by its seed."""
    docs = table(spark, d, "documents").withColumn("question", F.md5(F.coalesce("text", F.lit(""))))
    failing = docs.join(table(spark, d, "labels").filter("quality = 0"), "doc_id")
    samples = [reports.first_entries(rows.select(F.col(key).alias("key"), F.col("doc_id").alias("entry")), "key", "entry") for rows, key in ((failing, "question"), (docs.filter("doc_id % 3 = 0"), "source"))]
    questions = docs.select("doc_id", "question", F.col("source").alias("seed_question"))
    return reports.linked(questions, samples[0].unionByName(samples[1]), "entry").select("doc_id", "entry")


@query("""SELECT doc_id, CASE WHEN toxic = 1 AND doc_id % 5 = 0 THEN 'no stored answer' WHEN toxic = 1 AND doc_id % 5 = 1 THEN 'stored question differs' END AS error FROM labels""")
def stored_question_errors(spark: SparkSession, d: str) -> DataFrame:
    """Criterion rows whose run is missing or holds another question."""
    key, labelled = F.col("doc_id"), table(spark, d, "labels")
    rows = labelled.select("doc_id", _join("q", key).alias("question"), F.when(F.col("toxic") == 1, "criterion_only").otherwise("question_rewrite").alias("kind"))
    runs = labelled.filter(key % 5 != 0).select("doc_id", F.when(key % 5 == 1, "other").otherwise(_join("q", key)).alias("question"))
    return reports.stored_question_errors(rows, runs, "doc_id").select("doc_id", "error")


@query("""WITH e AS (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
SELECT user_id, max(CASE WHEN r = 1 THEN value END) AS seed_score, coalesce(round(avg(CASE WHEN r > 1 AND event_type = 'error' THEN value END), 2), 0) AS avg_updated_score FROM e WHERE r = 1 OR event_type = 'error' GROUP BY user_id""")
def updated_averages(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    first = events.groupBy("user_id").agg(F.min("event_id").alias("first"))
    scores = events.join(first, "user_id").withColumn("is_seed", F.col("event_id") == F.col("first")).filter("is_seed OR event_type = 'error'")
    return reports.updated_averages(scores, "user_id", F.col("is_seed"), "value")


@query("""WITH b AS (SELECT left(coalesce(text, ''), 3) AS bucket, count(*) AS n, arg_min(doc_id, doc_id) AS example FROM documents GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY n DESC, bucket) AS INTEGER) AS place, bucket, n, example FROM b QUALIFY place <= 12""")
def largest_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The twelve largest groups of texts by how they begin, each with its first."""
    docs = table(spark, d, "documents").select("doc_id", F.left(F.coalesce("text", F.lit("")), F.lit(3)).alias("begin"))
    return reports.buckets(docs, F.col("begin"), "doc_id", "doc_id", 12)


@query("""WITH u AS (SELECT seed, item, weight, (('0x' || substr(md5('menu' || seed || '|' || item), 1, 12))::BIGINT + 0.5) / 281474976710656 AS u
 FROM (SELECT DISTINCT lang AS seed FROM documents) CROSS JOIN (SELECT source AS item, CAST(count(*) AS DOUBLE) AS weight FROM documents GROUP BY source)),
m AS (SELECT seed, item FROM u QUALIFY row_number() OVER (PARTITION BY seed ORDER BY ln(u) / weight DESC, item) <= 6) SELECT item, count(*) AS draws FROM m GROUP BY item""")
def menu_draws(spark: SparkSession, d: str) -> DataFrame:
    """In how many seeds' menus each strategy was drawn."""
    docs = table(spark, d, "documents")
    pool = docs.groupBy(F.col("source").alias("item")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    drawn = clusters.weighted_menus(docs.select(F.col("lang").alias("seed")).distinct(), pool, "seed", "item", "weight", 6, "menu")
    return drawn.groupBy("item").agg(F.count(F.lit(1)).alias("draws"))


@query("""SELECT l_orderkey AS key, l_extendedprice AS score, 'snippets' AS pool FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, NULL, 'keyword' FROM lineitem WHERE l_linenumber = 2
UNION ALL SELECT o_orderkey, o_totalprice, 'extra' FROM orders WHERE o_orderstatus = 'P'""")
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    snippets = lines.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("score"))
    keyword = lines.filter("l_linenumber = 2").select(F.col("l_orderkey").alias("key"), F.lit(None).cast("double").alias("score"))
    extra = orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("score"))
    return reports.pool_of(snippets=snippets, keyword=keyword, extra=extra)


@query(f"""WITH {_CLUSTERS} SELECT source FROM y WHERE strategy <> '' AND k % 2 = 0 AND k % 5 IN (0, 2)""")
def clusters_on_menu(spark: SparkSession, d: str) -> DataFrame:
    """Clusters whose description is a strategy of the menu, however it is written there."""
    rows = _descriptions(spark, d)
    menu = rows.filter("k % 2 = 0").select(F.upper(_join("  plan ", F.col("source"))).alias("strategy"))
    return reports.menu_clusters(rows, menu, "description", "strategy").select("source")


@query(f"""WITH {_CLUSTERS}, b AS (SELECT 0 AS part, k AS ord, strategy FROM y WHERE strategy <> '' UNION ALL SELECT 1, k, CASE WHEN k % 3 = 0 THEN 'plan ' || source ELSE 'Ban ' || source END FROM c),
f AS (SELECT lower(strategy) AS key, arg_min(strategy, part * 1000 + ord) AS strategy, min(part * 1000 + ord) AS first FROM b GROUP BY 1) SELECT strategy, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS position FROM f""")
def cluster_seeds(spark: SparkSession, d: str) -> DataFrame:
    """What the next feedback is clustered against: all strategies, then base bans that say something else."""
    rows = _descriptions(spark, d)
    strategies = rows.select(F.col("k").alias("ord"), examples.clean_description(F.col("description")).alias("strategy"))
    bans = rows.select(F.col("k").alias("ord"), F.when(F.col("k") % 3 == 0, _join("plan ", F.col("source"))).otherwise(_join("Ban ", F.col("source"))).alias("strategy"))
    return reports.cluster_seeds(strategies, bans, "strategy")


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SQL_SPACE}'), lambda w: w <> '')[1:5] AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w), f AS (SELECT doc_id, lower(w) AS k, arg_min(w, i) AS w, min(i) AS i FROM e GROUP BY 1, 2)
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS phrases, count(w) AS n FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def searched_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The first five words of each document as phrases to search, repeats left out after the cut."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), scalar.SPACE), lambda w: w != "")
    found = table(spark, d, "documents").select("doc_id", reports.searched_phrases(words, 5).alias("p"))
    return found.select("doc_id", F.array_join("p", " ").alias("phrases"), F.size("p").cast("bigint").alias("n"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, 'Retrieved papers (' || max(n) || '):' || chr(10) || string_agg('  ' || r || '. [' || CASE WHEN o_orderkey % 7 = 0 THEN '?' ELSE y::VARCHAR END || '] P' || o_orderkey || ' (A, B, C)' || CASE WHEN o_orderkey % 2 = 0 THEN ' [Law, Biology]' ELSE '' END, chr(10) ORDER BY r) AS prompt
FROM o WHERE r <= 5 GROUP BY o_custkey""")
def papers_in_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's five dearest orders as papers in a scoring prompt."""
    key = F.col("o_orderkey")
    paper = F.struct(
        (-F.col("o_totalprice")).alias("rank"), key, F.when(key % 7 != 0, F.year("o_orderdate")).alias("year"), _join("P", key).alias("title"),
        F.array(*[F.lit(x) for x in "ABCD"]).alias("authors"), F.when(key % 2 == 0, F.array(F.lit("Law"), F.lit("Biology"))).alias("fields"),
    )
    grouped = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(paper)).alias("papers"))
    return grouped.select("o_custkey", reports.papers_in_prompt(F.col("papers")).alias("prompt"))


@query("""SELECT n_nationkey, n_nationkey % 3 <> 0 OR n_nationkey % 2 = 0 AS priced, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1000 ELSE greatest(2500, 1000 + n_nationkey * 200) END AS INTEGER) AS budget,
 CASE WHEN n_nationkey % 11 = 0 THEN 0 ELSE (n_nationkey % 11) / 10.0::DOUBLE END AS reward, n_nationkey % 4 = 1 AS hatch, n_regionkey = 2 OR n_nationkey % 5 = 0 AS wanted,
 CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE 'https://api.semanticscholar.org/CorpusID:' || n_nationkey END AS url FROM nation""")
def system_rules(spark: SparkSession, d: str) -> DataFrame:
    """Prices, token budgets, rewards, escape hatches, tools and links of invented systems, one a nation."""
    n, nations = F.col("n_nationkey"), table(spark, d, "nation")
    systems = nations.select(n, F.when(n % 3 != 0, "m").otherwise("unknown").alias("model"), F.when(n % 2 == 0, 1.0).alias("price_input"), F.when(n % 2 == 0, 2.0).alias("price_output"))
    pricing = spark.sql("SELECT 'm' AS model, 3.0D AS rate_in, 4.0D AS rate_out")
    priced = reports.priced_systems(systems, pricing).select("n_nationkey", F.lit(True).alias("priced"))
    provider = F.when(n % 2 == 0, "anthropic").otherwise("openai")
    score = F.when(n % 11 != 0, n % 11)
    criterion = F.when(n % 4 == 1, "  So: ANY non-empty answer is acceptable. ").otherwise("Name the year.")
    tool = F.when(F.col("n_regionkey") == 2, "search").otherwise("other")
    rules = nations.select(
        "n_nationkey", F.when(n % 2 == 0, reports.token_budget(provider, F.lit(1000), 1.0, 0)).otherwise(reports.token_budget(provider, (F.lit(1000) + n * 200).cast("int"), 1.0, 2500)).cast("int").alias("budget"),
        reports.reward(score).alias("reward"), reports.is_escape_hatch(criterion).alias("hatch"),
        (reports.tool_is(tool, "search") | (reports.tool_is(tool, "any") & (n % 5 == 0))).alias("wanted"), reports.corpus_url(F.when(n % 6 != 0, n)).alias("url"),
    )
    return rules.join(priced, "n_nationkey", "left").withColumn("priced", F.coalesce("priced", F.lit(False)))


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, source, CAST(greatest(round_even(40.0::DOUBLE * n / sum(n) OVER (PARTITION BY lang), 0), 1) AS INTEGER) AS concurrency FROM c""")
def cell_concurrency(spark: SparkSession, d: str) -> DataFrame:
    """A system's 40 places for its cells, in proportion to their seeds."""
    cells = table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("budget", F.lit(40.0))
    return reports.concurrency(cells, "lang", "n", "budget").select("lang", "source", "concurrency")


@query("""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, quality, toxic, doc_id % 3 AS kind FROM documents JOIN labels USING (doc_id))
SELECT doc_id::VARCHAR AS id, lang AS target_system, CASE kind WHEN 0 THEN 'passed_as_written' ELSE 'rewritten' END AS source, CASE kind WHEN 1 THEN 'new ' || left(text, 20) ELSE left(text, 20) END AS answer,
 CASE kind WHEN 1 THEN 're_answered' ELSE 'original_run' END AS answer_source, CASE kind WHEN 0 THEN CASE WHEN quality = 0 THEN 'FAILED' ELSE 'PASSED' END ELSE 'FAILED' END AS verdict,
 CASE kind WHEN 0 THEN 'original_run' ELSE 'rejudge' END AS judgment_source, doc_id % 4 = 0 AS vc_rewritten_inline, CASE WHEN quality = 1 THEN 'PASS' ELSE 'MINOR_REVISION' END AS question_review,
 4::INTEGER AS slots, 1::INTEGER AS filled, CASE WHEN kind <> 0 AND toxic = 1 THEN 'rewritten without a still_fails rejudge' WHEN kind = 0 AND quality = 1 THEN 'not a criterion failure' END AS error FROM d""")
def benchmark_samples(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark records of the labelled documents of four systems, and what of their nested parts a reader looks at."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    key, text, failed = F.col("doc_id"), F.left(F.coalesce("text", F.lit("")), F.lit(20)), F.col("quality") == 0
    as_written = key % 3 == 0
    verdict = F.when(failed, "FAILED").otherwise("PASSED")

    def judgment(told: Column, satisfied: Column) -> Column:
        return F.struct(told.alias("verdict"), satisfied.alias("criterion_satisfied"))

    def review(told: Column) -> Column:
        return F.struct(told.alias("verdict"), F.lit(7).alias("usage"), F.lit(0.1).alias("cost_usd"))

    told = F.when(~failed, "PASS").otherwise("MINOR_REVISION")
    rows = docs.select(
        key.cast("string").alias("id"), F.lit(None).cast("string").alias("domain"), F.col("lang").alias("system"), F.lit("explore").alias("prompt"), F.lit(0).alias("round"), F.col("source").alias("seed"),
        _join("question ", key).alias("question"), _join("criterion ", key).alias("criterion"), F.when(as_written, "passed_as_written").otherwise("rewritten").alias("source"), F.lit(None).cast("string").alias("rewrite_kind"),
        F.struct(F.lit("s").alias("strategy"), F.lit("w").alias("why_harder"), F.lit(1).alias("number"), text.alias("answer"), F.lit("m").alias("model"), F.when(key % 4 == 0, "old").otherwise("").alias("criterion_original")).alias("attempt"),
        judgment(verdict, ~failed).alias("judgment"),
        F.struct(F.lit("pass").alias("decision"), review(told).alias("question_review"), review(told).alias("vc_review")).alias("review"),
        F.struct(F.when(key % 3 == 1, "question_rewrite").otherwise("criterion_only").alias("kind"), F.when(F.col("toxic") == 1, "passes_now").otherwise("still_fails").alias("outcome"), F.concat(F.lit("new "), text).alias("answer"),
                 judgment(F.lit("FAILED"), F.lit(False)).alias("judgment"), F.lit("j").alias("judge_model"), F.lit("2024").alias("at")).alias("rejudged"),
    )
    made = reports.benchmark_records(rows, ["en", "de", "fr", "es"])
    slot = F.element_at("systems", F.col("target_system"))
    return made.select(
        "id", "target_system", "source", slot["answer"]["text"].alias("answer"), slot["answer"]["answer_source"].alias("answer_source"), slot["judgment"]["verdict"].alias("verdict"), slot["judgment"]["judgment_source"].alias("judgment_source"),
        "generation.vc_rewritten_inline", F.col("filter.question_review.verdict").alias("question_review"), F.size("systems").alias("slots"), F.size(F.map_filter("systems", lambda _, v: v.isNotNull())).alias("filled"), "error",
    )


@query("""WITH u AS (SELECT seed, item, weight, (('0x' || substr(md5('menu' || seed || '|' || item), 1, 12))::BIGINT + 0.5) / 281474976710656 AS u
 FROM (SELECT DISTINCT lang AS seed FROM documents) CROSS JOIN (SELECT source AS item, CAST(count(*) AS DOUBLE) AS weight FROM documents GROUP BY source)),
m AS (SELECT seed, item, weight FROM u QUALIFY row_number() OVER (PARTITION BY seed ORDER BY ln(u) / weight DESC, item) <= 6),
t AS (SELECT seed, 'Plan ' || substr(item, 1, 4) AS s, CAST(weight AS BIGINT) AS r FROM m UNION ALL SELECT DISTINCT seed, 'Something else', 4611686018427387904 FROM m),
f AS (SELECT seed, s, min(r) AS r FROM t GROUP BY 1, 2) SELECT seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY r, s) AS INTEGER) AS position, s AS strategy FROM f""")
def presented_menus(spark: SparkSession, d: str) -> DataFrame:
    """Each seed's drawn strategies in rank order, repeats once, the open end last."""
    docs = table(spark, d, "documents")
    pool = docs.groupBy(F.col("source").alias("item")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    drawn = clusters.weighted_menus(docs.select(F.col("lang").alias("seed")).distinct(), pool, "seed", "item", "weight", 6, "menu")
    rows = drawn.select("seed", F.concat(F.lit("Plan "), F.substring("item", 1, 4)).alias("strategy"), F.col("weight").alias("rank"))
    return examples.presented(rows, "seed", "rank", "strategy", "Something else")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt FROM events), f AS (SELECT user_id, min(attempt) AS first FROM a WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id, event_id, CAST(attempt AS INTEGER) AS attempt FROM a LEFT JOIN f USING (user_id) WHERE first IS NULL OR attempt <= first""")
def attempts_to_failure(spark: SparkSession, d: str) -> DataFrame:
    """The attempts of each seed up to its first failure."""
    from quarry.operators import retrieval  # noqa: PLC0415

    numbered = retrieval.attempt_numbers(table(spark, d, "events"), "user_id", ["ts", "event_id"])
    return examples.to_first_failure(numbered, "user_id", "attempt", F.col("event_type") == "error").select("user_id", "event_id", "attempt")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Plan ' || source WHEN 1 THEN 'EXHAUSTED ' || source ELSE source || ' | rest' END AS strategy FROM documents""")
def shot_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Strategies as worked examples show them: without the mark of an exhausted seed."""
    key = F.col("doc_id") % 3
    marked = F.when(key == 0, _join("EXHAUSTED (no failing answer found) | Plan ", F.col("source"))).when(key == 1, _join("EXHAUSTED ", F.col("source"))).otherwise(_join(F.col("source"), " | rest"))
    return table(spark, d, "documents").select("doc_id", examples.shot_strategy(marked).alias("strategy"))


@query("""WITH b AS (SELECT item_id, item_id % 4 AS g, trim(left(coalesce(text, ''), 20)) AS t FROM benchmark)
SELECT g, 'Before' || chr(10) || string_agg('Seed Question: ' || t || chr(10) || CASE WHEN item_id % 3 = 0 THEN '{}' ELSE '{' || chr(10) || '"chosen_strategy": "S' || item_id || '"' || CASE WHEN item_id % 3 = 1 THEN ',' || chr(10) || '"why_harder": "says \\"' || item_id || '\\""' ELSE '' END || chr(10) || '}' END, chr(10) || chr(10) ORDER BY item_id) || chr(10) || 'After' AS prompt
FROM b GROUP BY g""")
def prompts_with_shots(spark: SparkSession, d: str) -> DataFrame:
    """Prompts whose sentinel gives way to worked examples."""
    items, n = table(spark, d, "benchmark"), F.col("item_id")
    shot = F.struct(n, F.left(F.coalesce("text", F.lit("")), F.lit(20)).alias("seed_question"), F.when(n % 3 != 0, _join("S", n)).alias("chosen_strategy"), F.when(n % 3 == 1, _join('says "', n, '"')).otherwise("").alias("why_harder"))
    grouped = items.groupBy((n % 4).alias("g")).agg(F.array_sort(F.collect_list(shot)).alias("shots"))
    rendered = texts.rendered_shots(F.col("shots"), "seed_question", ("chosen_strategy", "why_harder"))
    return grouped.select("g", texts.filled(F.lit("Before\n{FEW_SHOT_EXAMPLES}\nAfter"), "{FEW_SHOT_EXAMPLES}", rendered).alias("prompt"))


@query("""WITH h AS (SELECT conv_id, turn, 'http://x/' || turn AS url FROM conversations WHERE turn % 2 = 0),
v AS (SELECT conv_id, 'http://x/' || turn AS url FROM conversations WHERE conv_id % 3 = 0 AND turn % 2 = 1)
SELECT conv_id, url FROM v UNION ALL SELECT conv_id, url FROM h WHERE conv_id NOT IN (SELECT conv_id FROM v) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3""")
def pool_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The pages that were visited, and of conversations without any the first three search hits."""
    turns = table(spark, d, "conversations").withColumn("url", _join("http://x/", F.col("turn")))
    visited = turns.filter("conv_id % 3 = 0 AND turn % 2 = 1")
    return answers.first_or_pool(visited, turns.filter("turn % 2 = 0"), "conv_id", "turn", 3)


@query("""WITH s AS (SELECT doc_id, unnest(['a', 'b', 'c']) AS system, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
v AS (SELECT doc_id, system, CASE system WHEN 'a' THEN CASE quality WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PASSED' END WHEN 'b' THEN CASE WHEN doc_id % 4 > 0 THEN 'FAILED' END ELSE CASE WHEN doc_id % 4 < 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'FAILED' ELSE 'PASSED' END END END AS verdict FROM s),
c AS (SELECT system, count(verdict) AS answered, count(verdict) * 2 >= (SELECT count(*) FROM documents) AS is_full FROM v GROUP BY system),
k AS (SELECT doc_id, count(verdict) AS a, count(CASE WHEN verdict = 'FAILED' THEN 1 END) AS f FROM v JOIN c USING (system) WHERE is_full GROUP BY doc_id)
SELECT system, answered, is_full, (SELECT count(*) FROM k WHERE a = (SELECT count(*) FROM c WHERE is_full)) AS complete, (SELECT count(*) FROM k WHERE f = (SELECT count(*) FROM c WHERE is_full)) AS failed_by_all FROM c""")
def system_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many samples each system answered, whether it counts as full, and what the full ones have all answered and all failed."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").withColumn("system", F.explode(F.array(*[F.lit(x) for x in "abc"])))
    key = F.col("doc_id")
    own = F.when(F.col("quality") == 0, "FAILED").when(F.col("quality") == 1, "PASSED")
    verdict = F.when(F.col("system") == "a", own).when(F.col("system") == "b", F.when(key % 4 > 0, "FAILED")).otherwise(F.when(key % 4 < 2, F.when(key % 3 == 0, "FAILED").otherwise("PASSED")))
    return review.coverage(rows.select("doc_id", "system", verdict.alias("verdict")), "doc_id", "system", "verdict")


_DECIDED = """d AS (SELECT doc_id, lang, source, n_chars, CASE WHEN quality IS NULL THEN 'error' WHEN quality = 0 AND toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'revise' ELSE 'pass' END AS decision,
 CASE WHEN quality IS NOT NULL THEN 'm' END AS model, coalesce(quality = 0 AND doc_id % 2 = 0, false) AS missing_rewrite, CASE WHEN n_chars > 3000 THEN 'too_long' WHEN doc_id % 9 = 0 THEN 'criterion_satisfied' END AS skip_reason
 FROM documents LEFT JOIN labels USING (doc_id))"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    bad = F.col("quality") == 0
    decision = F.when(F.col("quality").isNull(), "error").when(bad & (F.col("toxic") == 1), "reject").when(bad, "revise").otherwise("pass")
    reason = F.when(F.col("n_chars") > 3000, "too_long").when(F.col("doc_id") % 9 == 0, "criterion_satisfied")
    return docs.select("doc_id", "lang", "source", "n_chars", decision.alias("decision"), F.when(F.col("quality").isNotNull(), "m").alias("model"), F.coalesce(bad & (F.col("doc_id") % 2 == 0), F.lit(False)).alias("missing_rewrite"), reason.alias("skip_reason"))


@query(f"""WITH {_DECIDED} SELECT 'lang' AS key, lang AS value, decision, count(*) AS n, round(sum(n_chars / 1000), 4) AS cost FROM d GROUP BY lang, decision UNION ALL SELECT 'source', source, decision, count(*), round(sum(n_chars / 1000), 4) FROM d GROUP BY source, decision
UNION ALL SELECT 'skip_reason', skip_reason, decision, count(*), round(sum(n_chars / 1000), 4) FROM d GROUP BY skip_reason, decision UNION ALL SELECT 'all', NULL, decision, count(*), round(sum(n_chars / 1000), 4) FROM d GROUP BY decision""")
def decision_tables(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by system, by strategy and by skip reason, and over all, with what they cost."""
    rows = _decided(spark, d).withColumn("cost", F.col("n_chars") / 1000)
    return review.decision_tables(rows, ["lang", "source", "skip_reason"], "decision", "cost")


@query(f"""WITH {_DECIDED} SELECT count(*) AS items, count(model) AS judged, count(CASE WHEN decision = 'error' THEN 1 END) AS errors, count(CASE WHEN decision = 'pass' THEN 1 END) AS passes, count(CASE WHEN decision = 'revise' THEN 1 END) AS revisions,
 count(CASE WHEN decision = 'reject' THEN 1 END) AS rejections, count(CASE WHEN missing_rewrite THEN 1 END) AS missing_rewrites, count(CASE WHEN skip_reason = 'too_long' THEN 1 END) AS too_long, count(CASE WHEN skip_reason = 'criterion_satisfied' THEN 1 END) AS satisfied FROM d""")
def review_counters(spark: SparkSession, d: str) -> DataFrame:
    return review.review_counters(_decided(spark, d))
