"""Queries over what providers return: offsets, edits, answers with citations, nested documents.

A conversation stands for one provider's answer: a user's turn is a search with two results,
any other turn a text with two citations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import offsets
from quarry.operators import nested, provider_traces
from quarry.plans.registry import query, table


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, i, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(ch) AS begun FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM t WHERE text <> '')),
o AS (SELECT doc_id, text, b, CASE b WHEN 0 THEN doc_id % 400 WHEN 1 THEN (doc_id * 7919) % (strlen(text) + 3) ELSE strlen(text) - 2 END AS byte FROM t CROSS JOIN (SELECT unnest([0, 1, 2]) AS b))
SELECT o.doc_id, CAST(byte AS BIGINT) AS byte, CAST(CASE WHEN byte < 0 THEN -1 WHEN byte >= strlen(min(text)) THEN length(min(text)) ELSE count(c.i) - 1 END AS INTEGER) AS char
FROM o LEFT JOIN c ON c.doc_id = o.doc_id AND c.begun <= o.byte GROUP BY o.doc_id, b, byte""")
def char_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Three byte offsets into each document as character offsets."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("bigint")
    three = F.array(F.col("doc_id") % 400, (F.col("doc_id") * 7919) % (size + 3), size - 2)
    return docs.select("doc_id", "text", F.explode(three).alias("byte")).select("doc_id", "byte", offsets.char_offset(F.col("text"), F.col("byte")).alias("char"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CAST(doc_id % 50 AS INTEGER) AS a, CAST(60 + doc_id % 30 AS INTEGER) AS b FROM documents),
c AS (SELECT doc_id, text, a, substr(text, 1, b) || 'CUT' || substr(text, b + 11) AS one FROM t), m AS (SELECT doc_id, text, a, substr(one, 1, a) || '[1]' || substr(one, a + 1) AS two FROM c)
SELECT doc_id, md5(substr(two, 1, a) || '[2]' || substr(two, a + 1)) AS edited_md5, CAST(length(text) AS INTEGER) AS n_chars FROM m""")
def edited_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each document with two marks at one offset and a passage replaced, the edits given out of order."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    a, b = (F.col("doc_id") % 50).cast("int"), (F.col("doc_id") % 30 + 60).cast("int")

    def edit(start: Column, end: Column, text: str) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), F.lit(text).alias("text"))

    edits = F.array(edit(a, a, "[1]"), edit(b, b + 10, "CUT"), edit(a, a, "[2]"))
    return docs.select("doc_id", F.md5(offsets.edited(F.col("text"), edits)).alias("edited_md5"), F.length("text").alias("n_chars"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("asks"), F.coalesce("text", F.lit("")).alias("text"))
    site = F.concat(F.lit("org/p/"), (F.col("turn") % 3).cast("string"))
    return turns.withColumns({
        "query": F.left("text", F.lit(40)),
        "first": F.concat(F.lit("https://Site"), (F.col("conv_id") % 7).cast("string"), F.lit("."), site, F.lit("/")),
        "second": F.concat(F.lit("http://other.net/"), (F.col("turn") % 2).cast("string")),
        "cited": F.concat(F.lit("http://site"), (F.col("conv_id") % 7).cast("string"), F.lit("."), site, F.lit("?utm_source=x")),
        "cited_plain": F.concat(F.lit("http://site"), (F.col("conv_id") % 7).cast("string"), F.lit("."), site),
    })


def _listed(turns: DataFrame, item: Column) -> DataFrame:
    """(conv_id, items): a provider's list, one array a conversation; a conversation is one document."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", item.alias("item"))))
    return turns.groupBy("conv_id").agg(F.flatten(F.transform(ordered, lambda x: x["item"])).alias("items"))


def _struct(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


_LAST = """t AS (SELECT conv_id, turn, role = 'user' AS asks, coalesce(text, '') AS text, 'site' || conv_id % 7 || '.org/p/' || turn % 3 AS key, 'other.net/' || turn % 2 AS other FROM conversations),
l AS (SELECT conv_id, coalesce(max(CASE WHEN asks THEN turn END), -1) AS last FROM t GROUP BY conv_id),
f AS (SELECT t.*, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t JOIN l USING (conv_id) WHERE NOT asks AND turn > last)"""


@query(f"""WITH {_LAST}, s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS call, key, other FROM t WHERE asks),
r AS (SELECT conv_id, call, 0 AS spot, key FROM s UNION ALL SELECT conv_id, call, 1, other FROM s),
r1 AS (SELECT conv_id, key, 's' || (min(call * 2 + spot) // 2) || '-' || (min(call * 2 + spot) % 2) AS id FROM r GROUP BY conv_id, key),
c AS (SELECT conv_id, turn, 0 AS j, key, substr(text, 1, 12) AS quote FROM f UNION ALL SELECT conv_id, turn, 1, 'unseen.org/' || turn % 2, '' FROM f),
x AS (SELECT conv_id, key, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn * 2 + j)) - 1 AS n FROM c WHERE (conv_id, key) NOT IN (SELECT (conv_id, key) FROM r1) GROUP BY conv_id, key),
i AS (SELECT c.*, coalesce(r1.id, 'cited-' || x.n) AS id FROM c LEFT JOIN r1 USING (conv_id, key) LEFT JOIN x USING (conv_id, key)),
m AS (SELECT conv_id, turn, string_agg(id, ' ' ORDER BY j) AS ids FROM i GROUP BY conv_id, turn),
a AS (SELECT conv_id, string_agg('<cite id="' || ids || '">' || text || '</cite>', '' ORDER BY turn) AS answer FROM f JOIN m USING (conv_id, turn) GROUP BY conv_id)
SELECT l.conv_id, md5(coalesce(a.answer, '')) AS answer_md5, (SELECT count(*) FROM r WHERE r.conv_id = l.conv_id) + (SELECT count(*) FROM x WHERE x.conv_id = l.conv_id) AS documents,
 (SELECT count(*) FROM s WHERE s.conv_id = l.conv_id) AS searches, (SELECT count(*) FROM c WHERE c.conv_id = l.conv_id) AS citations,
 (SELECT count(*) FROM t WHERE t.conv_id = l.conv_id AND NOT asks AND turn < last) AS interim,
 (SELECT count(DISTINCT i.id) FROM i WHERE i.conv_id = l.conv_id AND trim(i.quote, chr(10) || chr(9) || ' ') <> '') AS quoted FROM l LEFT JOIN a USING (conv_id)""")
def cited_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Answers of content blocks: cited texts in tags, sources numbered by search and result, unseen ones apart."""
    turns = _turns(spark, d)
    none, text = F.lit(None).cast("string"), F.col("text")
    results = F.array(_struct(url=F.col("first"), title=F.lit("a")), _struct(url=F.col("second"), title=F.lit("b")))
    no_results, no_cites = F.array().cast("array<struct<url:string,title:string>>"), F.array().cast("array<struct<url:string,title:string,cited_text:string>>")
    unseen = F.concat(F.lit("https://unseen.org/"), (F.col("turn") % 2).cast("string"))
    cites = F.array(_struct(url=F.col("cited_plain"), title=F.lit("c"), cited_text=F.left(text, F.lit(12))), _struct(url=unseen, title=F.lit("u"), cited_text=F.lit("")))
    id_ = F.concat(F.lit("t"), F.col("turn").cast("string"))

    def block(kind: str, name: Column = none, tool: Column = none, answers: Column = none, asked: Column = none, found: Column = no_results, said: Column = none, cited: Column = no_cites) -> Column:
        return _struct(type=F.lit(kind), name=name, id=tool, tool_use_id=answers, query=asked, error=none, results=found, text=said, citations=cited)

    search = F.array(block("server_tool_use", F.lit("web_search"), id_, asked=F.col("query")), block("web_search_tool_result", answers=id_, found=results))
    listed = _listed(turns, F.when(F.col("asks"), search).otherwise(F.array(block("text", said=text, cited=cites))))
    told = provider_traces.from_blocks(listed, "items").withColumnRenamed("told", "t")
    quoted = F.size(F.filter("t.documents", lambda x: x["snippet"] != ""))
    sizes = [F.size(f"t.{field}").cast("bigint").alias(name) for field, name in (("documents", "documents"), ("calls", "searches"), ("interim", "interim"))]
    return told.select("conv_id", F.md5("t.answer").alias("answer_md5"), *sizes, F.col("t.citations").cast("bigint").alias("citations"), quoted.cast("bigint").alias("quoted"))


@query(f"""WITH {_LAST}, u AS (SELECT conv_id, key, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS n FROM f GROUP BY conv_id, key),
a AS (SELECT conv_id, string_agg(substr(text, 1, 20) || '<cite id="c-' || u.n || '"></cite>' || substr(text, 21) || ' see <cite id="c-' || u.n || '"></cite>.', '' ORDER BY turn) AS answer FROM f JOIN u USING (conv_id, key) GROUP BY conv_id)
SELECT l.conv_id, md5(coalesce(answer, '')) AS answer_md5, (SELECT count(*) FROM u WHERE u.conv_id = l.conv_id) AS documents, (SELECT 2 * count(*) FROM f WHERE f.conv_id = l.conv_id) AS citations,
 (SELECT string_agg('http://' || key || '|' || key, ',' ORDER BY n) FROM u WHERE u.conv_id = l.conv_id) AS sources FROM l LEFT JOIN a USING (conv_id)""")
def linked_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of response items: links become marks, other citations are marked at their end; tracking parameters count for nothing."""
    turns = _turns(spark, d)
    link = F.concat(F.lit("([link]("), F.col("cited"), F.lit("))"))
    said = F.concat("text", F.lit(" see "), link, F.lit("."))
    begin = F.length("text") + 5

    def note(url: Column, start: Column, end: Column) -> Column:
        return _struct(type=F.lit("url_citation"), url=url, title=F.col("key"), start_index=start, end_index=end)

    end = F.least(F.length("text"), F.lit(20))
    notes = F.array(note(F.col("cited"), begin, begin + F.length(link)), note(F.col("cited_plain"), F.lit(0), end))
    keyed = turns.withColumn("key", F.regexp_replace("cited_plain", "^http://", ""))
    none, content = F.lit(None).cast("string"), F.array(_struct(type=F.lit("output_text"), text=said, refusal=F.lit(None).cast("string"), annotations=notes))
    search = _struct(type=F.lit("web_search_call"), status=F.lit("completed"), kind=F.lit("search"), queries=F.array("query"), url=none, sources=F.array("first", "second"), content=F.lit(None).cast(provider_traces._CONTENT))
    message = _struct(type=F.lit("message"), status=none, kind=none, queries=F.lit(None).cast("array<string>"), url=none, sources=F.lit(None).cast("array<string>"), content=content)
    told = provider_traces.from_items(_listed(keyed, F.array(F.when(F.col("asks"), search).otherwise(message))), "items").withColumnRenamed("told", "t")
    sources = F.array_join(F.transform("t.documents", lambda x: F.concat(x["url"], F.lit("|"), x["title"])), ",")
    return told.select("conv_id", F.md5("t.answer").alias("answer_md5"), F.size("t.documents").cast("bigint").alias("documents"), F.col("t.citations").cast("bigint").alias("citations"), F.nullif(sources, F.lit("")).alias("sources"))


@query(f"""WITH {_LAST}, u AS (SELECT conv_id, turn % 3 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS n FROM f GROUP BY conv_id, turn % 3),
a AS (SELECT f.conv_id, string_agg(substr(text, 1, 15) || '<cite id="g-' || u.n || '"></cite>' || substr(text, 16), '' ORDER BY turn) AS answer FROM f JOIN u ON u.conv_id = f.conv_id AND u.k = f.turn % 3 GROUP BY f.conv_id)
SELECT l.conv_id, md5(coalesce(answer, '')) AS answer_md5, (SELECT count(*) FROM u WHERE u.conv_id = l.conv_id) AS documents,
 (SELECT string_agg(CASE WHEN k = 2 THEN '' ELSE 'https://real.org/' || k END, ',' ORDER BY n) FROM u WHERE u.conv_id = l.conv_id) AS sources FROM l LEFT JOIN a USING (conv_id)""")
def byte_marked_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of steps whose citations end at byte offsets, two URLs to a source, one source unresolved."""
    k = (F.col("turn") % 3).cast("string")
    urls = [F.concat(F.lit(f"https://redirect/{side}/"), k) for side in ("a", "b")]
    held = F.left("text", F.lit(15))
    notes = F.array(*[_struct(type=F.lit("url_citation"), url=F.when(F.col("turn") % 3 == 2, urls[0]).otherwise(url), title=F.lit("t"), start_index=F.lit(0), end_index=F.octet_length(held)) for url in urls])
    content = F.array(_struct(type=F.lit("text"), text=F.col("text"), refusal=F.lit(None).cast("string"), annotations=notes))
    search = _struct(type=F.lit("google_search_call"), queries=F.array("query"), is_error=F.lit(False), content=F.lit(None).cast(provider_traces._CONTENT))
    output = _struct(type=F.lit("model_output"), queries=F.lit(None).cast("array<string>"), is_error=F.lit(False), content=content)
    resolved = F.create_map(*[F.lit(x) for side in ("a", "b") for n in (0, 1) for x in (f"https://redirect/{side}/{n}", f"https://real.org/{n}")])
    listed = _listed(_turns(spark, d), F.array(F.when(F.col("asks"), search).otherwise(output)))
    told = provider_traces.from_steps(listed, "items", resolved).withColumnRenamed("told", "t")
    sources = F.array_join(F.transform("t.documents", lambda x: x["url"]), ",")
    none = F.size("t.documents") == 0
    return told.select("conv_id", F.md5("t.answer").alias("answer_md5"), F.size("t.documents").cast("bigint").alias("documents"), F.when(~none, sources).alias("sources"))


_PROPS = """n AS (SELECT event_id, event_type, value, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """A nested document of each event, with keys to strip at three depths."""
    events = table(spark, d, "events").select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    inner = _struct(signature=F.lit("s"), kind=F.col("event_type"), list=F.array(_struct(encrypted_content=F.lit("e"), k=F.col("k")), _struct(encrypted_content=F.lit("e"), k=F.col("k") + 1)))
    bare = _struct(type=F.lit("redacted_thinking"), data=F.lit("secret"))
    return events.withColumn("document", F.to_json(_struct(id=F.col("event_id"), signature=F.lit("x"), inner=inner, bare=bare)))


@query(f"""WITH {_PROPS} SELECT event_id, '{{"id":' || event_id || ',"inner":{{"kind":"' || event_type || '","list":[{{"k":' || k || '}},{{"k":' || (k + 1) || '}}]}},"bare":{{"type":"redacted_thinking"}}}}' AS document FROM n""")
def stripped_documents(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents without signatures and encrypted fields at any depth."""
    keys = ("encrypted_content", "encrypted_index", "signature")
    return _documents(spark, d).select("event_id", nested.without_keys(F.col("document"), keys, ("redacted_thinking",)).alias("document"))


@query(f"""WITH {_PROPS}, m AS (SELECT event_id, unnest([{{'path': 'trainer.id', 'override': 'trainer.id=' || event_id}}, {{'path': 'trainer.data.kind', 'override': 'trainer.data.kind="' || event_type || ' of ' || user_id || '"'}},
 {{'path': 'trainer.data.steps', 'override': 'trainer.data.steps=[' || k || ',True,None,' || event_type || ']'}}, {{'path': 'trainer.data.none', 'override': 'trainer.data.none=null'}}, {{'path': 'on', 'override': 'on=' || CASE WHEN k > 50 THEN 'true' ELSE 'false' END}}, {{'path': 'name', 'override': 'name=' || event_type}}, {{'path': 'blank', 'override': 'blank=""'}}]) AS o FROM n)
SELECT event_id, o.path AS path, o.override AS override FROM m""")
def config_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Nested settings of each event as overrides by dotted path."""
    events = table(spark, d, "events").select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    text = F.concat(
        F.lit('{"trainer":{"id":'), F.col("event_id").cast("string"), F.lit(',"data":{"kind":"'), "event_type", F.lit(" of "), F.col("user_id").cast("string"), F.lit('","steps":['), F.col("k").cast("string"),
        F.lit(',true,null,"'), "event_type", F.lit('"],"none":null}},"on":'), (F.col("k") > 50).cast("string"), F.lit(',"name":"'), "event_type", F.lit('","blank":"","empty":{}}'),
    )
    return nested.overrides(nested.leaves(events.select("event_id", text.alias("document")), "event_id", "document"))


@query("""SELECT conv_id, turn, CAST(CASE WHEN turn % 3 = 2 THEN NULL ELSE length(CASE WHEN turn % 3 = 1 THEN '' ELSE coalesce(text, '') END) END AS BIGINT) AS answer_chars,
 CASE WHEN turn % 2 = 0 THEN turn % 4 = 0 END AS trace_present, role FROM conversations""")
def redacted_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Response bodies without answer and trace, their sizes kept."""
    turns = table(spark, d, "conversations")
    answer = F.when(F.col("turn") % 3 == 0, F.coalesce("text", F.lit(""))).when(F.col("turn") % 3 == 1, "")
    trace = F.when(F.col("turn") % 2 == 0, F.when(F.col("turn") % 4 == 0, '"trace":[{"a":1}],').otherwise('"trace":null,')).otherwise("")
    body = F.concat(F.lit("{"), trace, F.substr(F.to_json(_struct(answer=answer, role=F.col("role"))), F.lit(2)))
    read = turns.select("conv_id", "turn", F.from_json(nested.redacted(body), "answer string, trace string, answer_chars bigint, trace_present boolean, role string").alias("b"))
    return read.filter("b.answer IS NULL AND b.trace IS NULL").select("conv_id", "turn", "b.answer_chars", "b.trace_present", "b.role")


@query("""WITH i AS (SELECT item_id, list_filter(string_split(coalesce(text, ''), '.'), lambda x: trim(x, chr(10) || ' ') <> '') AS s FROM benchmark),
e AS (SELECT item_id, unnest(s) AS q, generate_subscripts(s, 1) AS p FROM i), k AS (SELECT item_id, trim(q, chr(10) || ' ') AS q, p, lower(trim(regexp_replace(q, '\\s+', ' ', 'g'))) AS key FROM e),
f AS (SELECT item_id, min_by(q, p) AS q, min(p) AS p FROM k GROUP BY item_id, key) SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY p) AS INTEGER) AS place, q AS query FROM f QUALIFY place <= 3""")
def proposed_queries(spark: SparkSession, d: str) -> DataFrame:
    """The first three different sentences of each item, proposed as texts, objects, repeats and blanks in turns."""
    items = table(spark, d, "benchmark").select("item_id", F.split(F.coalesce("text", F.lit("")), r"\.").alias("s"))
    said = F.flatten(F.transform("s", lambda q, i: F.when(i % 2 == 0, F.array(F.to_json(_struct(query=q)), F.to_json(_struct(query=F.lower(q))), F.lit('"  "'), F.lit("7"))).otherwise(F.array(F.to_json(F.array(q)).substr(F.lit(2), F.length(F.to_json(F.array(q))) - 2)))))
    document = F.concat(F.lit('{"queries":['), F.array_join(said, ","), F.lit("]}"))
    told = items.select("item_id", nested.proposals(nested.records(document, "queries"), "query", 3).alias("q"))
    return told.select("item_id", F.posexplode("q").alias("at", "query")).select("item_id", (F.col("at") + 1).alias("place"), "query")
