"""Answers and their references: inline citations, numbering, reference blocks, searches of a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import truthy
from quarry.functions.text import fetch_failed, url_label, words

#: An inline citation (ids, claim), and tool responses of a message trace.
CITE = r'(?s)<cite\s+id="([^"]+)">(.*?)</cite>'
RESPONSE = r"(?s)<tool_response>\s*(.*?)\s*</tool_response>"
SEARCH = r"(?i)^A Google (search|scholar) for '([^']*)'"
VISIT = r"(?s)^The useful information in (\S+) for user goal (.*?) as follows:\s*(.*)$"


def has_citations(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(CITE)


def cite_ids(raw: Column) -> Column:
    """The ids of one citation, at commas and white space."""
    return F.filter(F.split(F.trim(raw), r"[,\s]+"), lambda x: x != "")


def citations(answer: Column) -> Column:
    """An array of (ids, claim) of an answer's citations in order."""
    ids = F.transform(F.regexp_extract_all(answer, F.lit(CITE), 1), cite_ids)
    return F.arrays_zip(ids.alias("ids"), F.regexp_extract_all(answer, F.lit(CITE), 2).alias("claim"))


def resolved(answer: Column, keys: Column) -> Column:
    """(text, refs, missing): claims with [n] marks, the keys by first appearance, and ids that `keys` (id to key) lacks.

    Ids of one key share its number; an id without a key gets no mark.
    """
    cited = citations(answer)
    ids = F.flatten(F.transform(cited, lambda c: c["ids"]))
    refs = F.array_distinct(F.filter(F.transform(ids, lambda i: F.try_element_at(keys, i)), lambda k: k.isNotNull()))

    def marked(c: Column) -> Column:
        known = F.filter(F.transform(c["ids"], lambda i: F.try_element_at(keys, i)), lambda k: k.isNotNull())
        marks = F.array_join(F.transform(known, lambda k: F.concat(F.lit("["), F.array_position(refs, k).cast("string"), F.lit("]"))), "")
        return F.when(marks == "", c["claim"]).otherwise(F.rtrim(F.concat_ws(" ", c["claim"], marks)))

    between = F.split(answer, CITE, -1)
    # There is one piece more between citations than there are citations.
    pieces = F.zip_with(between, F.transform(cited, marked), lambda text, claim: F.concat(text, F.coalesce(claim, F.lit(""))))
    missing = F.array_distinct(F.filter(ids, lambda i: F.try_element_at(keys, i).isNull()))
    return F.struct(F.array_join(pieces, "").alias("text"), refs.alias("refs"), missing.alias("missing"))


def reference_lines(refs: Column, snippet_words: int | None = None) -> Column:
    """A "References" block of an array of (title, url[, snippet]); empty without any."""

    def line(r: Column, i: Column) -> Column:
        head = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(truthy(r["title"]), F.lit("(untitled)")))
        url = F.coalesce(F.concat(F.lit(" — "), truthy(r["url"])), F.lit(""))
        if snippet_words is None:
            return F.concat(head, url)
        ws = words(F.coalesce(r["snippet"], F.lit("")))
        cut = F.concat(F.array_join(F.slice(ws, 1, snippet_words), " "), F.when(F.size(ws) > snippet_words, " …").otherwise(""))
        return F.concat(head, url, F.when(F.size(ws) > 0, F.concat(F.lit("\n    snippet: "), cut)).otherwise(""))

    block = F.array_join(F.transform(refs, line), "\n" if snippet_words is None else "\n\n")
    return F.when(F.size(refs) > 0, F.concat(F.lit("\n\nReferences\n"), block)).otherwise("")


def trace_shape(trace: Column) -> Column:
    """Which of the three shapes a trace in JSON has: calls, explorer, messages, or other."""
    first = F.get_json_object(trace, "$[0]")
    is_list = F.trim(trace).startswith("[")
    return (
        F.when(~is_list & F.get_json_object(trace, "$.tool_calls").isNotNull(), "calls")
        .when(is_list & F.get_json_object(first, "$.Input").isNotNull(), "explorer")
        .when(is_list & F.get_json_object(first, "$.role").isNotNull() & F.get_json_object(first, "$.content").isNotNull(), "messages")
        .otherwise("other")
    )


def tool_responses(messages: DataFrame, trace: str, order: str, content: str) -> DataFrame:
    """(trace, order, place, body) of every tool response in the messages."""
    found = F.posexplode(F.regexp_extract_all(F.coalesce(F.col(content), F.lit("")), F.lit(RESPONSE), 1)).alias("place", "body")
    return messages.select(trace, order, found).withColumn("body", F.trim("body"))


def searches_run(responses: DataFrame) -> DataFrame:
    """`responses` that are searches or visits, with `tool` and `query`; a visit's query is its page."""
    tool = F.when(F.col("body").rlike(SEARCH), F.concat(F.lit("google_"), F.lower(F.regexp_extract("body", SEARCH, 1)))).when(
        F.col("body").rlike(VISIT), "visit"
    )
    query = F.when(F.col("body").rlike(SEARCH), F.regexp_extract("body", SEARCH, 2)).otherwise(F.regexp_extract("body", VISIT, 1))
    return responses.withColumns({"tool": tool, "query": query}).filter("tool IS NOT NULL")


def visits(responses: DataFrame, trace: str, order: str) -> DataFrame:
    """(trace, url, order, goal, evidence) of each page's first visit that reached it."""
    parsed = responses.filter(F.col("body").rlike(VISIT)).select(
        trace, order, "place", *[F.regexp_extract("body", VISIT, i).alias(n) for i, n in ((1, "url"), (2, "goal"), (3, "evidence"))]
    )
    evidence = F.trim(F.regexp_replace(F.trim("evidence"), r"(?i)^\s*Evidence in page:\s*", ""))
    reached = parsed.withColumns({"evidence": evidence, "goal": F.trim("goal")}).filter(~fetch_failed(F.col("evidence")))
    first = reached.groupBy(trace, "url").agg(F.min(F.struct(order, "place", "goal", "evidence")).alias("v"))
    return first.select(trace, "url", f"v.{order}", "v.goal", "v.evidence")


def visit_titles(found: DataFrame, pool: DataFrame, trace: str) -> DataFrame:
    """`found` visits with a `title`: the search pool's, a heading of the evidence, the URL's label, or the URL."""
    heading = F.regexp_extract("evidence", r"(?m)^(?:#{1,4}\s*|Title:\s*)(.+)$", 1)
    joined = found.join(pool.select(trace, "url", F.col("title").alias("__title")), [trace, "url"], "left")
    title = F.coalesce(truthy(F.col("__title")), truthy(F.left(F.trim(heading), F.lit(200))), truthy(url_label(F.col("url"))), F.col("url"))
    return joined.withColumn("title", title).drop("__title")


def first_or_pool(found: DataFrame, pool: DataFrame, trace: str, order: str, n: int = 10) -> DataFrame:
    """(trace, url): the visits, and of traces without any the first n of the search pool."""
    place = F.row_number().over(Window.partitionBy(trace).orderBy(order))
    rest = pool.join(found.select(trace).distinct(), trace, "left_anti").withColumn("__n", place).filter(F.col("__n") <= n)
    return found.select(trace, "url").unionByName(rest.select(trace, "url"))
