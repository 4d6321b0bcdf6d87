"""Queries on papers, answers with references, and text fields.

Stand-ins: lineitem holds passages of orders (papers); conversations hold answers whose
turns cite the sources s0 to s4; benchmark items number made-up URLs and phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scalar, text
from quarry.operators import answers, papers
from quarry.plans.registry import SQL_SPACE, query, table


def _string(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- papers ---

_PASSAGES = """p AS (SELECT l_orderkey AS paper, (l_orderkey * 8 + l_linenumber) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus) AS ord, CASE WHEN l_suppkey % 17 = 0 THEN '' ELSE 'text ' || l_partkey END AS text,
 l_extendedprice AS score, CASE WHEN l_returnflag = 'A' THEN l_quantity * 5000 END AS rerank_score,
 CASE l_partkey % 4 WHEN 0 THEN 'abstract' WHEN 1 THEN 'Methods' WHEN 2 THEN 'title' END AS section,
 CASE WHEN l_linestatus = 'F' THEN 'public_api' ELSE 'body' END AS kind, CAST(l_quantity AS BIGINT) AS at FROM lineitem)"""


def _passages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    # Lines repeat, so a passage's number tells them apart.
    again = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    part = F.col("l_partkey") % 4
    return rows.select(
        F.col("l_orderkey").alias("paper"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000 + F.row_number().over(again)).alias("ord"),
        F.when(F.col("l_suppkey") % 17 == 0, "").otherwise(_string("text ", F.col("l_partkey"))).alias("text"),
        F.col("l_extendedprice").alias("score"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity") * 5000).alias("rerank_score"),
        F.when(part == 0, "abstract").when(part == 1, "Methods").when(part == 2, "title").alias("section"),
        F.when(F.col("l_linestatus") == "F", "public_api").otherwise("body").alias("kind"),
        F.col("l_quantity").cast("bigint").alias("at"),
    )


@query(f"""WITH {_PASSAGES} SELECT paper, max(coalesce(rerank_score, score)) AS relevance, count(CASE WHEN kind <> 'public_api' THEN 1 END) AS n_passages,
 min(ord) AS position, coalesce(nullif(any_value(CASE WHEN o_orderstatus = 'F' THEN 'own abstract' ELSE '' END), ''), arg_min(text, ord) FILTER (section = 'abstract')) AS abstract
 FROM p JOIN orders ON o_orderkey = paper WHERE text <> '' GROUP BY paper""")
def papers_of_passages(spark: SparkSession, d: str) -> DataFrame:
    metadata = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), F.when(F.col("o_orderstatus") == "F", "own abstract").otherwise("").alias("abstract"))
    return papers.aggregated(_passages(spark, d), metadata, "paper", "ord").select("paper", "relevance", "n_passages", "position", "abstract")


@query(f"""WITH {_PASSAGES}, s AS (SELECT paper, coalesce(section, '') AS section, string_agg(text, chr(10) || '...' || chr(10) ORDER BY "at", text) AS t, min("at") AS first FROM p
 WHERE coalesce(section, '') NOT IN ('abstract', 'title') GROUP BY 1, 2)
SELECT q.paper, coalesce(string_agg('## ' || section || chr(10) || t, chr(10) || chr(10) ORDER BY first, section), '') AS text
FROM (SELECT DISTINCT paper FROM p) q LEFT JOIN s ON s.paper = q.paper GROUP BY q.paper""")
def paper_sections(spark: SparkSession, d: str) -> DataFrame:
    return papers.sections(_passages(spark, d), "paper")


@query(f"WITH {_PASSAGES} SELECT ord, score FROM p ORDER BY score DESC, ord LIMIT 40")
def reranked_passages(spark: SparkSession, d: str) -> DataFrame:
    return papers.reranked(_passages(spark, d), "score", "ord", 40).select("ord", "score")


@query(f"""WITH {_PASSAGES} SELECT ord FROM p WHERE text <> '' AND section <> '' AND "at" <> 0 AND coalesce(rerank_score, 0) >= 50000""")
def complete_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = papers.complete(_passages(spark, d), ["text", "section", "at"])
    return rows.filter(F.coalesce("rerank_score", F.lit(0.0)) >= 50000).select("ord")


@query("SELECT DISTINCT l_orderkey AS paper FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def metadata_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("paper"))
    return papers.missing_metadata(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper")), known, "paper")


@query("""SELECT o_orderkey AS paper, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderpriority END AS title FROM orders""")
def refreshed_metadata(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), F.col("o_orderpriority").alias("title"))
    fresh = found.filter("paper % 3 = 0").select("paper", F.lit("new").alias("title"))
    return papers.refreshed(found, fresh, "paper", ["title"])


_FIELDS = ["Biology", "History", "Physics", "Computer Science", "Law", "Unknown"]


@query(f"""WITH o AS (SELECT o_custkey % 50 AS question, CAST(year(o_orderdate) AS INTEGER) AS year, {_FIELDS!r}[1 + o_orderkey % 6] AS field, o_orderkey % 97 = 0 AS summary,
 CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 1000 END AS citations FROM orders)
SELECT question, count(*) AS n, max(year) AS max_year, round(avg(year), 1) AS avg_year, round(count(CASE WHEN year >= 1995 THEN 1 END) / count(*), 2) AS pct_recent,
 max(year) - min(year) AS year_spread, bool_or(summary) AS has_summary, round(avg(citations), 1) AS avg_citations, min(citations) AS min_citations, max(citations) AS max_citations,
 string_agg(DISTINCT field, ',' ORDER BY field) AS fields, count(DISTINCT field) AS n_fields,
 count(DISTINCT CASE field WHEN 'Biology' THEN 1 WHEN 'History' THEN 2 WHEN 'Physics' THEN 3 WHEN 'Computer Science' THEN 4 ELSE 5 END) AS n_groups FROM o GROUP BY question""")
def literature_signals(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        (F.col("o_custkey") % 50).alias("question"),
        F.year("o_orderdate").alias("year"),
        F.array(F.get(F.lit(_FIELDS), (key % 6).cast("int"))).alias("fields"),
        F.when(key % 97 == 0, "A Systematic Review of it").otherwise("Plain").alias("title"),
        F.when(key % 5 > 0, key % 1000).alias("citations"),
    )
    return papers.signals(rows, "question", 2000)


_DISTANCE = """1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * x[2])) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x)))
 * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x))))"""


@query(f"""SELECT a.vec_id // 6 AS question, round(avg({_DISTANCE}), 6) AS avg_distance, round(max({_DISTANCE}), 6) AS max_distance
FROM embeddings a JOIN embeddings b ON a.vec_id // 6 = b.vec_id // 6 AND a.vec_id < b.vec_id GROUP BY 1""")
def concept_distances(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.expr("vec_id div 6").alias("question"), "vec_id", "embedding")
    found = papers.pairwise_distance(rows, "question", "vec_id", "embedding")
    return found.select("question", *[F.round(c, 6).alias(c) for c in ("avg_distance", "max_distance")])


@query("""WITH t AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), b AS (SELECT p_brand, count(*) AS together FROM part WHERE p_size < 5 GROUP BY 1)
SELECT p_brand, round((max(coalesce(together, 0)) + 1) / (exp(avg(ln(greatest(n, 1)))) + 1), 6) AS rarity FROM t LEFT JOIN b USING (p_brand) GROUP BY p_brand""")
def concept_rarity(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    each = parts.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    both = parts.filter("p_size < 5").groupBy("p_brand").agg(F.count(F.lit(1)).alias("together"))
    counts = each.join(both, "p_brand", "left").na.fill(0, ["together"])
    return papers.rarity(counts, "p_brand", "n", "together").withColumn("rarity", F.round("rarity", 6))


@query(f"""WITH s AS (SELECT embedding FROM embeddings WHERE vec_id < 10), n AS (SELECT a.vec_id, min({_DISTANCE}) AS x FROM embeddings a CROSS JOIN s b GROUP BY a.vec_id)
SELECT round(min(x), 4) + 0.0 AS nearest_min, round(avg(x), 4) AS nearest_mean, round(max(x), 4) AS nearest_max FROM n""")
def nearest_seed_summary(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators import retrieval  # noqa: PLC0415

    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = retrieval.nearest_seed(vectors, vectors.filter("vec_id < 10").select(F.col("vec_id").alias("seed_id"), "embedding"), "vec_id", "embedding", "seed_id")
    x = F.col("distance")
    return found.agg((F.round(F.min(x), 4) + 0.0).alias("nearest_min"), F.round(F.avg(x), 4).alias("nearest_mean"), F.round(F.max(x), 4).alias("nearest_max"))


@query("""SELECT p_brand, CASE WHEN count(n) = 0 THEN 'NULL' WHEN count(n) = 1 THEN string_split(min(n), ' ')[-1] ELSE string_split(arg_min(n, p_partkey), ' ')[-1] || ' et al.' END AS authors
FROM (SELECT p_brand, p_partkey, CASE WHEN p_size > 49 THEN p_name END AS n FROM part) GROUP BY p_brand""")
def author_strings(spark: SparkSession, d: str) -> DataFrame:
    named = F.when(F.col("p_size") > 49, F.struct("p_partkey", "p_name"))
    grouped = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(named)).alias("a"))
    return grouped.select("p_brand", text.author_string(F.col("a.p_name")).alias("authors"))


@query("SELECT o_orderkey, '[' || o_orderkey || ' | ' || string_split(o_orderpriority, '-')[1] || ' | ' || year(o_orderdate) || ' | Citations: ' || o_custkey || ']' AS reference FROM orders")
def reference_strings(spark: SparkSession, d: str) -> DataFrame:
    authors = F.array(F.substring_index("o_orderpriority", "-", 1))
    made = text.reference_string(F.col("o_orderkey"), authors, F.year("o_orderdate"), F.col("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", made.alias("reference"))


# --- answers ---

_CITED = """c AS (SELECT conv_id, turn, text, unnest([1, 2]) AS pos, unnest(['s' || (turn % 3), 's' || (turn % 5)]) AS id FROM conversations),
k AS (SELECT *, CASE id WHEN 's4' THEN NULL WHEN 's0' THEN 'k0' WHEN 's2' THEN 'k0' ELSE 'k1' END AS key FROM c),
f AS (SELECT conv_id, key, min(turn * 10 + pos) AS first FROM k WHERE key IS NOT NULL GROUP BY 1, 2),
n AS (SELECT conv_id, key, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS n FROM f)"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    cite = F.concat(F.lit('<cite id="s'), (F.col("turn") % 3).cast("string"), F.lit(",  s"), (F.col("turn") % 5).cast("string"), F.lit('">'), "text", F.lit("</cite>"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cite.alias("c")))).alias("t"))
    return grouped.select("conv_id", F.array_join("t.c", "\n").alias("answer"))


def _keys() -> Column:
    known = {"s0": "k0", "s1": "k1", "s2": "k0", "s3": "k1"}
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])


@query(f"""WITH {_CITED}, t AS (SELECT k.conv_id, k.turn, any_value(k.text) AS text, string_agg('[' || n.n || ']', '' ORDER BY pos) AS marks FROM k
 LEFT JOIN n ON n.conv_id = k.conv_id AND n.key = k.key GROUP BY 1, 2)
SELECT t.conv_id, string_agg(CASE WHEN marks IS NULL THEN text ELSE text || ' ' || marks END, chr(10) ORDER BY turn) AS answer,
 any_value((SELECT string_agg(key, ',' ORDER BY n.n) FROM n WHERE n.conv_id = t.conv_id)) AS refs,
 any_value((SELECT string_agg(DISTINCT id, ',') FROM k WHERE k.conv_id = t.conv_id AND key IS NULL)) AS missing FROM t GROUP BY t.conv_id""")
def numbered_answers(spark: SparkSession, d: str) -> DataFrame:
    found = _answers(spark, d).select("conv_id", answers.resolved(F.col("answer"), _keys()).alias("r"))
    empty = F.lit("")
    return found.select(
        "conv_id",
        F.col("r.text").alias("answer"),
        F.nullif(F.array_join("r.refs", ","), empty).alias("refs"),
        F.nullif(F.array_join("r.missing", ","), empty).alias("missing"),
    )


@query("""SELECT conv_id, CASE WHEN conv_id % 4 > 0 THEN string_agg('s' || (turn % 3) || '+s' || (turn % 5), ' ' ORDER BY turn) ELSE '' END AS ids,
 CASE WHEN conv_id % 4 > 0 THEN count(*) ELSE 0 END AS n, conv_id % 4 > 0 AS has FROM conversations GROUP BY conv_id""")
def cited_ids(spark: SparkSession, d: str) -> DataFrame:
    # Every fourth answer has lost its tags.
    bare = F.regexp_replace("answer", "</?cite[^>]*>", "")
    given = _answers(spark, d).withColumn("answer", F.when(F.col("conv_id") % 4 == 0, bare).otherwise(F.col("answer")))
    cited = answers.citations(F.col("answer"))
    ids = F.array_join(F.transform(cited, lambda c: F.array_join(c["ids"], "+")), " ")
    return given.select("conv_id", ids.alias("ids"), F.size(cited).cast("bigint").alias("n"), answers.has_citations(F.col("answer")).alias("has"))


@query(f"""WITH w AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, list_filter(regexp_split_to_array(text, '{SQL_SPACE}'), lambda w: w <> '') AS ws FROM conversations)
SELECT conv_id, chr(10) || chr(10) || 'References' || chr(10) || string_agg('[' || number || '] ' || CASE WHEN turn % 2 = 0 THEN 'Title ' || turn ELSE '(untitled)' END ||
 CASE WHEN turn % 3 = 0 THEN ' — http://x/' || turn ELSE '' END || CASE WHEN len(ws) > 0 THEN chr(10) || '    snippet: ' || array_to_string(ws[1:7], ' ') || CASE WHEN len(ws) > 7 THEN ' …' ELSE '' END ELSE '' END,
 chr(10) || chr(10) ORDER BY turn) AS block FROM w GROUP BY conv_id""")
def reference_blocks(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    ref = F.struct(
        "turn",
        F.when(turn % 2 == 0, _string("Title ", turn)).otherwise("").alias("title"),
        F.when(turn % 3 == 0, _string("http://x/", turn)).alias("url"),
        F.col("text").alias("snippet"),
    )
    grouped = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(ref)).alias("refs"))
    return grouped.select("conv_id", answers.reference_lines(F.col("refs"), 7).alias("block"))


_BODY = """m AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'A Google search for ''query ' || turn || ''' found 2 results:' WHEN 1 THEN
 'The useful information in https://arxiv.org/abs/1234.0000' || turn || ' for user goal g' || turn || ' as follows: Evidence in page: ' || repeat('word ', 60) || text
 WHEN 2 THEN 'The useful information in http://wall/' || turn || ' for user goal g as follows: Just a moment ' || repeat('x ', 200) ELSE 'plain' END AS body FROM conversations)"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    turn, kind = F.col("turn"), F.col("turn") % 4
    body = (
        F.when(kind == 0, _string("A Google search for 'query ", turn, "' found 2 results:"))
        .when(kind == 1, _string("The useful information in https://arxiv.org/abs/1234.0000", turn, " for user goal g", turn, " as follows: Evidence in page: ", "word " * 60, F.col("text")))
        .when(kind == 2, _string("The useful information in http://wall/", turn, " for user goal g as follows: Just a moment ", "x " * 200))
        .otherwise("plain")
    )
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("note <tool_response>\n"), body, F.lit("\n</tool_response>")).alias("content"))


@query(f"""WITH {_BODY} SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'google_search' ELSE 'visit' END AS tool, CASE turn % 4 WHEN 0 THEN 'query ' || turn
 WHEN 1 THEN 'https://arxiv.org/abs/1234.0000' || turn ELSE 'http://wall/' || turn END AS query FROM m WHERE turn % 4 < 3""")
def searches_of_traces(spark: SparkSession, d: str) -> DataFrame:
    found = answers.tool_responses(_messages(spark, d), "conv_id", "turn", "content")
    return answers.searches_run(found).select("conv_id", "turn", "tool", "query")


@query(f"""WITH {_BODY} SELECT conv_id, turn, 'https://arxiv.org/abs/1234.0000' || turn AS url, 'g' || turn AS goal, CASE WHEN turn % 8 = 1 THEN 'Hit ' || conv_id ELSE 'arXiv:1234.0000' || turn END AS title FROM m WHERE turn % 4 = 1""")
def visited_pages(spark: SparkSession, d: str) -> DataFrame:
    responses = answers.tool_responses(_messages(spark, d), "conv_id", "turn", "content")
    found = answers.visits(responses, "conv_id", "turn")
    # Searches found every other page, and some that nobody visited.
    turns = table(spark, d, "conversations")
    seen = turns.filter(F.col("turn") % 8 != 5).select("conv_id", _string("https://arxiv.org/abs/1234.0000", F.col("turn")).alias("url"), _string("Hit ", F.col("conv_id")).alias("title"))
    pool = seen.dropDuplicates(["conv_id", "url"])
    return answers.visit_titles(found, pool, "conv_id").select("conv_id", "turn", "url", "goal", "title")


@query("""SELECT conv_id, turn, ['calls', 'explorer', 'messages', 'other', 'other'][1 + turn % 5] AS shape FROM conversations""")
def trace_shapes(spark: SparkSession, d: str) -> DataFrame:
    kinds = ['{"tool_calls": []}', '[{"Input": "x"}]', '[{"role": "user", "content": "x"}]', '"text"', "[]"]
    turns = table(spark, d, "conversations")
    return turns.select("conv_id", "turn", answers.trace_shape(F.get(F.lit(kinds), (F.col("turn") % 5).cast("int"))).alias("shape"))


# --- text fields ---


@query(r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS folded FROM documents")
def ascii_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.ascii_fold("text").alias("folded"))


@query(f"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{SQL_SPACE}'), lambda w: w <> '') AS ws FROM documents)
SELECT doc_id, array_to_string(ws[1:12], ' ') || CASE WHEN len(ws) > 12 THEN ' …' ELSE '' END AS abridged,
 CASE WHEN length(text) > 400 THEN left(text, 400) || chr(10) || '...[truncated]' ELSE text END AS capped FROM w""")
def shortened_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scalar.abridge(F.col("text"), 12).alias("abridged"), text.capped(F.col("text"), 400).alias("capped"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def escaped_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", scalar.escape_html(F.col("html")).alias("escaped"))


@query(r"""SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}]', '_', 'g') AS safe, replace(url, '/', '__') || '.json' AS file FROM pages""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.safe_name(F.col("url")).alias("safe"), text.file_name(F.col("url")).alias("file"))


@query(r"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), x AS (SELECT page_id, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS r FROM u)
SELECT page_id, lower(regexp_extract(r, '^([^/?]*)', 1)) || regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key
FROM (SELECT *, list_filter(string_split(regexp_extract(r, '\?(.*)$', 1), '&'), lambda p: regexp_matches(p, '=.') AND NOT starts_with(lower(p), 'utm_')) AS q FROM x)""")
def untracked_url_keys(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace("url", "#.*$", "")
    tracked = F.concat(plain, F.when(F.instr(plain, "?") > 0, "&").otherwise("?"), F.lit("utm_source=a&UTM_x=1&utm_empty="), F.lit("#part"))
    return table(spark, d, "pages").select("page_id", text.url_key_untracked(tracked).alias("key"))


@query("""SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'arXiv:1234.' || lpad(item_id::VARCHAR, 5, '0') WHEN 1 THEN 'ACL Anthology P' || item_id || '-1' WHEN 2 THEN 'doi:10.1/' || item_id WHEN 3 THEN 'PMC PMC' || item_id ELSE '' END AS label,
 CASE WHEN item_id % 5 = 0 THEN '1234.' || lpad(item_id::VARCHAR, 5, '0') END AS arxiv, CASE WHEN item_id % 5 = 4 THEN repeat('ab', 20) END AS paper FROM benchmark""")
def url_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("item_id")
    url = (
        F.when(n % 5 == 0, _string("https://arxiv.org/pdf/1234.", F.lpad(n.cast("string"), 5, "0")))
        .when(n % 5 == 1, _string("https://aclanthology.org/P", n, "-1.pdf"))
        .when(n % 5 == 2, _string("https://doi.org/10.1/", n, "?x=1"))
        .when(n % 5 == 3, _string("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC", n, "/"))
        .otherwise(_string("https://www.semanticscholar.org/paper/Some-Title/", "ab" * 20))
    )
    ids = text.paper_ids(url)
    return table(spark, d, "benchmark").select("item_id", text.url_label(url).alias("label"), ids["arxiv"].alias("arxiv"), ids["paper"].alias("paper"))


@query("""WITH b AS (SELECT item_id, item_id % 7 + 1 AS a, item_id % 5 + 1 AS lo, item_id % 5 + 1 + (item_id * 7) % 30 AS hi FROM benchmark)
SELECT item_id, array_to_string(list_sort(list_distinct(list_concat([a, 40], CASE WHEN hi > lo AND hi - lo <= 20 THEN range(lo, hi + 1) ELSE [lo, hi] END))), ',') AS pages FROM b""")
def page_back_references(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("item_id")
    low = n % 5 + 1
    said = _string("See web pages ", n % 7 + 1, ", ", low, " - ", low + (n * 7) % 30, ", and 40 notes 3-5 years")
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.page_numbers(said), ",").alias("pages"))


@query("""SELECT item_id, item_id::VARCHAR AS found, '[' || item_id || ']' AS listed, CAST(CASE WHEN item_id % 3 = 0 THEN 5 ELSE greatest(1, least(10, item_id % 12)) END AS INTEGER) AS score FROM benchmark""")
def json_and_scores(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("item_id")
    said = F.when(n % 2 == 0, _string("Sure:\n```json\n{\"a\": ", n, "}\n``` {x}")).otherwise(_string("text {\"a\": ", n, "} tail"))
    score = F.when(n % 3 == 0, "no number, 0 or 77").otherwise(_string("I say ", n % 12, " of 10"))
    return table(spark, d, "benchmark").select(
        "item_id",
        F.get_json_object(text.first_json(said), "$.a").alias("found"),
        text.first_array(_string("so [", n, "] it is")).alias("listed"),
        text.clamp(text.score_in_text(score), 1, 10).alias("score"),
    )


@query("""SELECT doc_id, CASE WHEN n_chars < 60 THEN printf('%.1fs', n_chars::DOUBLE) WHEN n_chars < 3600 THEN printf('%dm %ds', n_chars // 60, n_chars % 60)
 ELSE printf('%dh %dm %ds', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) END AS elapsed FROM documents""")
def elapsed_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.elapsed(F.col("n_chars").cast("double")).alias("elapsed"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'a.org' WHEN n_nationkey % 3 = 1 THEN 'a.org and b.org' ELSE 'a.org, b.org and c.org' END AS listed,
 CASE n_nationkey % 4 WHEN 0 THEN ':2021-06' WHEN 1 THEN '2019:2020' WHEN 2 THEN '2021:2021-06' ELSE ':2021-06' END AS dates,
 CASE WHEN n_nationkey % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider FROM nation""")
def domain_phrases(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    domains = F.slice(F.lit(["a.org", "b.org", "c.org"]), F.lit(1), (n % 3 + 1).cast("int"))
    years = F.when(n % 4 == 1, "2019-2020").when(n % 4 == 2, "2023-2025").when(n % 4 == 3, "-")
    model = F.when(n % 4 == 0, "GPT-5").when(n % 4 == 2, "o3-mini").otherwise("o3x")
    return table(spark, d, "nation").select("n_nationkey", text.listed(domains).alias("listed"), text.date_range(years, F.lit("2021-06")).alias("dates"), text.provider(model).alias("provider"))


@query("""SELECT item_id, regexp_replace(replace(text, ', ', ' – '), '\\s*–\\s*', '-', 'g') AS searched FROM benchmark""".replace("\\\\", "\\"))
def dashed_phrases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", text.plain_dashes(F.replace("text", F.lit(", "), F.lit(" – "))).alias("searched"))


@query(r"""SELECT doc_id, length(text) < 200 OR doc_id % 10 = 3 OR doc_id % 10 = 4 AND length(text) <= 390 AS failed,
 CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN regexp_matches(substr(text, 1, 30), '(?i)^https?://|^microsoft word\b|^[\w.\-]+\.pdf$|^untitled') WHEN 3 THEN true ELSE false END AS unusable,
 length(text) > 5000 OR length(text) - length(replace(text, chr(10), '')) >= 5 AS suspicious FROM documents""")
def text_checks(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("text")
    lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    key = F.col("doc_id")
    # The mark behind a text ends ten characters after it, so one of over 390 characters moves it out of the window.
    denied = F.concat(F.lit("Access DENIED. "), F.coalesce(body, F.lit("")))
    evidence = F.when(key % 10 == 3, denied).when(key % 10 == 4, F.concat(body, F.lit(" - captcha"))).otherwise(body)
    title = F.when(key % 5 == 0, _string("https://x.org/", key)).when(key % 5 == 1, _string("paper_", key, ".pdf")).when(key % 5 == 2, F.substring(body, 1, 30)).when(key % 5 == 3, "Microsoft Word - draft").otherwise("A title, untitled")
    return table(spark, d, "documents").select(
        "doc_id",
        text.fetch_failed(evidence).alias("failed"),
        text.unusable_title(title).alias("unusable"),
        ((F.length(body) > 5000) | (lines >= 5)).alias("suspicious"),
    )
