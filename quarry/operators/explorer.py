"""Sources of explorer traces, titles from fallback tables, and answers as a judge reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import strip, truthy
from quarry.functions.text import page_numbers, unusable_title
from quarry.operators.answers import has_citations, reference_lines, resolved

#: A search result in a call's input, and the characters of a fetched page that count as evidence.
PAGE = r"(?s)\*\*\*Web Page (\d+):\*\*\*\s*(\{.*?\n\})"
PAGE_CHARS = 2000
#: A fixed value: the heading of sources that no claim cites.
SOURCES = "SOURCES (retrieved while researching; not claim-level citations)"


def explorer_sources(calls: DataFrame, trace: str, call: str) -> DataFrame:
    """(trace, call, place, page, title, url, snippet, query, backref, selected) of calls (input, extracted, search_query).

    A call's input holds its results as numbered JSON blocks; a block that is no JSON loses one
    page, and of blocks with one number the last counts, at the first one's place.  A page that
    the extracted text refers back to is a back-reference and shows what was fetched, if it
    was; the others show the search's snippet.  A call that refers back to none of its pages
    selects all of them.
    """
    numbers, blocks = (F.regexp_extract_all("input", F.lit(PAGE), k) for k in (1, 2))
    pairs = F.arrays_zip(numbers.alias("page"), blocks.alias("raw"))
    cited = F.transform(F.coalesce(page_numbers("extracted"), F.array().cast("array<int>")), lambda n: n.cast("string"))
    found = calls.select(trace, call, "search_query", cited.alias("cited"), F.posexplode(pairs).alias("place", "pair"))
    parsed = found.filter(F.try_parse_json("pair.raw").isNotNull())
    read = parsed.select("*", F.col("pair.page").alias("page"), F.from_json("pair.raw", "title string, url string, snippet string, page_info string").alias("doc"))
    pages = read.groupBy(trace, call, "page").agg(F.min("place").alias("place"), F.max_by(F.struct("doc", "search_query", "cited"), "place").alias("d"))
    text = {name: F.coalesce(F.col(f"d.doc.{name}"), F.lit("")) for name in ("title", "url", "snippet", "page_info")}
    marked = pages.withColumn("backref", F.array_contains("d.cited", F.col("page")))
    any_cited = F.max("backref").over(Window.partitionBy(trace, call))
    fetched = F.col("backref") & (text["page_info"] != "")
    return marked.select(
        trace, call, "place", "page",
        F.coalesce(truthy(text["title"]), F.lit("(untitled)")).alias("title"),
        text["url"].alias("url"),
        F.when(fetched, F.left(text["page_info"], F.lit(PAGE_CHARS))).otherwise(text["snippet"]).alias("snippet"),
        F.coalesce("d.search_query", F.lit("")).alias("query"),
        "backref",
        (F.col("backref") | ~any_cited).alias("selected"),
    )


def titled(docs: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """`docs` (key, title) with `title_source`: unusable titles from the first table (key, title) that has one, or else the second.

    Usable ones, and those no table knows, are as the provider gave them (api).
    """
    one, other = (t.select(key, F.col("title").alias(name)) for t, name in ((first, "__first"), (second, "__second")))
    joined = docs.join(one, key, "left").join(other, key, "left")
    bad = unusable_title(strip(F.coalesce("title", F.lit(""))))
    looked = F.coalesce(truthy(F.col("__first")), truthy(F.col("__second")))
    source = F.when(truthy(F.col("__first")).isNotNull(), "first").otherwise("second")
    changed = bad & looked.isNotNull()
    return joined.withColumns({"title_source": F.when(changed, source).otherwise("api"), "title": F.when(changed, looked).otherwise(F.col("title"))}).drop("__first", "__second")


def judge_text(answer: Column, documents: Column, selected: Column, snippet_words: int) -> Column:
    """A struct (text, inline): an answer's citations as numbers with their references, or without any its selected sources listed.

    `documents` is an array of (id, title, url, snippet), `selected` such an array.  A null answer is empty.
    """
    body = F.coalesce(answer, F.lit(""))
    ids = F.transform(documents, lambda d: d["id"])
    told = resolved(body, F.map_from_arrays(ids, ids))
    cited = F.transform(told["refs"], lambda i: F.get(documents, F.array_position(ids, i).cast("int") - 1))
    listed = F.regexp_replace(reference_lines(selected, snippet_words), r"^\n\nReferences\n", f"\n\n{SOURCES}\n")
    inline = has_citations(body)
    text = F.when(inline, F.concat(told["text"], reference_lines(cited, snippet_words))).otherwise(F.concat(body, listed))
    return F.struct(text.alias("text"), inline.alias("inline"))
