"""Answers with citations from what providers return, a record each: content blocks, response items, or steps.

Every function takes rows with an array column in the order of the provider's list and adds
the struct `told` (answer, documents, calls, interim, citations).  The answer is the text after the last
search; what was written between searches is interim.  A source has one number, that of its
first appearance, whatever its URL's cosmetic differences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.offsets import EDITS, char_offset, edited
from quarry.functions.scalar import strip, url_key
from quarry.functions.text import url_key_untracked

_SOURCE = "struct<url:string,title:string>"
BLOCKS = (
    "array<struct<type:string,name:string,id:string,tool_use_id:string,query:string,error:string,"
    f"results:array<{_SOURCE}>,text:string,citations:array<struct<url:string,title:string,cited_text:string>>>>"
)
_NOTE = "struct<type:string,url:string,title:string,start_index:int,end_index:int>"
_CONTENT = f"array<struct<type:string,text:string,refusal:string,annotations:array<{_NOTE}>>>"
ITEMS = f"array<struct<type:string,status:string,kind:string,queries:array<string>,url:string,sources:array<string>,content:{_CONTENT}>>"
STEPS = f"array<struct<type:string,queries:array<string>,is_error:boolean,content:{_CONTENT}>>"

#: A fixed value: an inline Markdown link, with or without brackets around it.
LINK = r"^\s*\(?\s*\[[^\]]*\]\([^)]*\)\s*\)?\s*\z"


class _Stages:
    """Rows to which helper columns are added, so that a value that many expressions read is worked out once a row."""

    def __init__(self, rows: DataFrame) -> None:
        self.before, self.rows = rows.columns, rows

    def keep(self, name: str, value: Column) -> Column:
        while name in self.rows.columns:
            name += "_"
        self.rows = self.rows.withColumn(name, value)
        return F.col(f"`{name}`")

    def end(self, told: Column) -> DataFrame:
        return self.rows.withColumn("told", told).select(*[F.col(f"`{c}`") for c in self.before if c != "told"], "told")


def _rows(array: Column, kind: str) -> Column:
    return F.coalesce(array, F.array().cast(kind))


def _last(items: Column, is_tool: Callable[[Column], Column]) -> Column:
    """Position of the last tool item, -1 without one."""
    return F.coalesce(F.array_max(F.transform(items, lambda x, i: F.when(is_tool(x), i))), F.lit(-1))


def _given(url: Column) -> Column:
    return F.coalesce(url, F.lit("")) != ""


def _first_of(items: Column, keys: Column, key: Column) -> Column:
    """The item at the first place of `key` among the items' keys; null if it is not there."""
    return F.get(items, F.nullif(F.array_position(keys, key), F.lit(0)).cast("int") - 1)


def from_blocks(rows: DataFrame, column: str) -> DataFrame:
    """Of content blocks (`BLOCKS`): cited texts are wrapped in tags of (call, result) ids, quotes become snippets.

    A result belongs to the last search with its id.  A cited URL that no search returned
    counts as result of a last call `cited`.
    """
    stages = _Stages(rows)
    keep = stages.keep
    blocks = keep("__blocks", _rows(F.col(column).cast(BLOCKS), BLOCKS))
    searches = keep("__searches", F.filter(blocks, lambda b: (b["type"] == "server_tool_use") & (b["name"] == "web_search")))
    call_ids = keep("__call_ids", F.transform(searches, lambda b: b["id"]))
    answered = keep("__answered", F.filter(blocks, lambda b: (b["type"] == "web_search_tool_result") & F.array_contains(call_ids, b["tool_use_id"])))

    def call_of(b: Column) -> Column:
        """Position of the block's call: the last search with its id."""
        return F.size(call_ids) - F.array_position(F.reverse(call_ids), b["tool_use_id"]).cast("int")

    results = keep("__results", F.flatten(
        F.transform(answered, lambda b: F.transform(F.filter(_rows(b["results"], f"array<{_SOURCE}>"), lambda r: b["error"].isNull() & _given(r["url"])), lambda r: F.struct(call_of(b).alias("call"), r["url"].alias("url"), r["title"].alias("title"))))
    ))
    placed = keep("__placed", F.transform(results, lambda r, i: F.struct(r["call"], r["url"], r["title"], (F.size(F.filter(F.slice(results, 1, i + 1), lambda x: x["call"] == r["call"])) - 1).alias("at"), url_key(strip(r["url"])).alias("key"))))
    last = keep("__last", _last(blocks, lambda b: b["type"].isin("server_tool_use", "web_search_tool_result")))
    texts = keep("__texts", F.filter(F.transform(blocks, lambda b, i: F.struct(b["type"].alias("type"), F.coalesce(b["text"], F.lit("")).alias("text"), b["citations"].alias("citations"), i.alias("i"))), lambda b: b["type"] == "text"))
    cite = "array<struct<url:string,title:string,cited_text:string>>"
    final = keep("__final", F.transform(F.filter(texts, lambda t: t["i"] > last), lambda t: F.struct(t["text"], F.filter(_rows(t["citations"], cite), lambda c: _given(c["url"])).alias("citations"))))
    cited = keep("__cited", F.transform(F.flatten(F.transform(final, lambda t: t["citations"])), lambda c: F.struct(c["url"], c["title"], c["cited_text"], url_key(strip(c["url"])).alias("key"))))
    known = keep("__known", F.transform(placed, lambda r: r["key"]))
    extra = keep("__extra", F.array_distinct(F.transform(F.filter(cited, lambda c: ~F.array_contains(known, c["key"])), lambda c: c["key"])))
    searched = keep("__searched", F.size(call_ids))

    def name(call: Column, at: Column) -> Column:
        label = F.when(call < searched, F.concat(F.lit("s"), (call + 1).cast("string"))).otherwise(F.lit("cited"))
        return F.concat(label, F.lit("-"), at.cast("string"))

    def id_of(key: Column) -> Column:
        found = _first_of(placed, known, key)
        return F.coalesce(name(found["call"], found["at"]), F.concat(F.lit("cited-"), (F.array_position(extra, key) - 1).cast("string")))

    def tagged(t: Column) -> Column:
        ids = F.array_join(F.array_distinct(F.transform(t["citations"], lambda c: id_of(url_key(strip(c["url"]))))), " ")
        tag = F.concat(F.lit('<cite id="'), ids, F.lit('">'))
        inside = strip(t["text"]) != ""
        return F.when(ids == "", t["text"]).when(inside, F.concat(tag, t["text"], F.lit("</cite>"))).otherwise(F.concat(tag, F.lit("</cite>"), t["text"]))

    def document(id_: Column, url: Column, title: Column) -> Column:
        quotes = F.transform(F.filter(cited, lambda c: id_of(c["key"]) == id_), lambda c: strip(F.coalesce(c["cited_text"], F.lit(""))))
        snippet = F.array_join(F.array_distinct(F.filter(quotes, lambda q: q != "")), " … ")
        return F.struct(id_.alias("id"), F.coalesce(title, F.lit("")).alias("title"), url.alias("url"), snippet.alias("snippet"))

    # By call and place in it, as the calls list them.
    ordered = F.array_sort(F.transform(placed, lambda r: F.struct(r["call"], r["at"], r["url"], r["title"])))
    found = F.transform(ordered, lambda r: document(name(r["call"], r["at"]), r["url"], r["title"]))
    more = F.transform(extra, lambda key: document(id_of(key), _first_of(cited, F.transform(cited, lambda c: c["key"]), key)["url"], _first_of(cited, F.transform(cited, lambda c: c["key"]), key)["title"]))
    errors = F.transform(searches, lambda b, i: F.struct(F.concat(F.lit("s"), (i + 1).cast("string")).alias("call_id"), F.coalesce(b["query"], F.lit("")).alias("query"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(answered, lambda a: a["error"].isNotNull() & (call_of(a) == i)), lambda a: a["error"])), -1).alias("error")))
    told = F.struct(
        strip(F.array_join(F.transform(final, tagged), "")).alias("answer"),
        F.concat(found, more).alias("documents"),
        errors.alias("calls"),
        F.transform(F.filter(texts, lambda t: t["i"] < last), lambda t: t["text"]).alias("interim"),
        F.size(cited).alias("citations"),
    )
    return stages.end(told)


def _notes(part: Column) -> Column:
    return F.filter(_rows(part["annotations"], f"array<{_NOTE}>"), lambda a: (a["type"] == "url_citation") & _given(a["url"]))


def _parts(items: Column, kind: str, text_kind: str, last: Column, after: bool) -> Column:
    """Text parts of the messages after the last search, or before it."""
    messages = F.filter(F.transform(items, lambda o, i: F.struct(o["type"].alias("type"), o["content"].alias("content"), i.alias("i"))), lambda o: (o["type"] == kind) & ((o["i"] > last) if after else (o["i"] <= last)))
    return F.filter(F.flatten(F.transform(messages, lambda o: _rows(o["content"], _CONTENT))), lambda c: c["type"] == text_kind)


def _tag(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(f'<cite id="{prefix}-'), number.cast("string"), F.lit('"></cite>'))


def from_items(rows: DataFrame, column: str) -> DataFrame:
    """Of response items (`ITEMS`): an inline link becomes a mark, other cited text is marked at its end.

    URLs count without tracking parameters.  Refusals stand among the interim texts.
    """
    stages = _Stages(rows)
    keep = stages.keep
    items = keep("__items", _rows(F.col(column).cast(ITEMS), ITEMS))
    last = keep("__last", _last(items, lambda o: o["type"] == "web_search_call"))
    parts = keep("__parts", _parts(items, "message", "output_text", last, True))
    notes = keep("__notes", F.flatten(F.transform(parts, _notes)))
    keys = keep("__keys", F.array_distinct(F.transform(notes, lambda a: url_key_untracked(a["url"]))))

    def marked(c: Column) -> Column:
        text = F.coalesce(c["text"], F.lit(""))

        def edit(a: Column) -> Column:
            start, end = (F.coalesce(a[f"{side}_index"], F.lit(0)) for side in ("start", "end"))
            held = F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))
            return F.struct(F.when(held.rlike(LINK), start).otherwise(end).alias("start"), end.alias("end"), _tag("c", F.array_position(keys, url_key_untracked(a["url"])) - 1).alias("text"))

        return edited(text, F.transform(_notes(c), edit).cast(EDITS))

    def document(key: Column, i: Column) -> Column:
        first = _first_of(notes, F.transform(notes, lambda a: url_key_untracked(a["url"])), key)
        clean = F.regexp_replace(F.regexp_replace(first["url"], r"[?&]utm_[^&#]*", ""), r"[?&]+$", "")
        return F.struct(F.concat(F.lit("c-"), i.cast("string")).alias("id"), F.coalesce(F.nullif(first["title"], F.lit("")), clean).alias("title"), clean.alias("url"), F.lit("").alias("snippet"))

    calls = F.filter(items, lambda o: o["type"] == "web_search_call")
    refusals = F.flatten(F.transform(F.filter(items, lambda o: o["type"] == "message"), lambda o: F.filter(_rows(o["content"], _CONTENT), lambda c: c["type"] == "refusal")))
    before = F.transform(_parts(items, "message", "output_text", last, False), lambda c: c["text"])
    told = F.struct(
        strip(F.array_join(F.transform(parts, marked), "")).alias("answer"),
        F.transform(keys, document).alias("documents"),
        F.transform(calls, lambda o, i: F.struct(F.concat(F.lit("s"), (i + 1).cast("string")).alias("call_id"), F.array_join(F.coalesce(o["queries"], F.array().cast("array<string>")), " | ").alias("query"), F.when(o["status"] != "completed", o["status"]).alias("error"))).alias("calls"),
        F.concat(before, F.transform(refusals, lambda c: F.concat(F.lit("[refusal] "), F.coalesce(c["refusal"], F.lit(""))))).alias("interim"),
        F.size(notes).alias("citations"),
    )
    return stages.end(told)


def from_steps(rows: DataFrame, column: str, resolved: Column) -> DataFrame:
    """Of steps (`STEPS`) whose citations end at byte offsets; `resolved` is a map from a cited URL to the real one.

    Sources that resolve to one URL are one; all sources that end at a character share a mark.
    """
    stages = _Stages(rows)
    keep = stages.keep
    steps = keep("__steps", _rows(F.col(column).cast(STEPS), STEPS))
    last = keep("__last", _last(steps, lambda s: s["type"] == "google_search_call"))
    parts = keep("__parts", _parts(steps, "model_output", "text", last, True))

    def key(url: Column) -> Column:
        return F.coalesce(F.element_at(resolved, url), url)

    notes = keep("__notes", F.flatten(F.transform(parts, _notes)))
    keys = keep("__keys", F.array_distinct(F.transform(notes, lambda a: key(a["url"]))))

    texts = keep("__texts", F.transform(parts, lambda c: F.coalesce(c["text"], F.lit(""))))
    whole = F.array_join(texts, "")

    def ends_of(c: Column, i: Column) -> Column:
        begin = F.length(F.array_join(F.slice(texts, 1, i), ""))
        at = lambda a: begin + char_offset(F.get(texts, i), F.coalesce(a["end_index"], F.lit(0)))
        return F.transform(_notes(c), lambda a: F.struct(at(a).alias("end"), (F.array_position(keys, key(a["url"])) - 1).alias("number")))

    ends = keep("__ends", F.flatten(F.transform(parts, ends_of)))

    def edit(end: Column) -> Column:
        ids = F.array_distinct(F.transform(F.filter(ends, lambda e: e["end"] == end), lambda e: F.concat(F.lit("g-"), e["number"].cast("string"))))
        return F.struct(end.alias("start"), end.alias("end"), F.concat(F.lit('<cite id="'), F.array_join(ids, " "), F.lit('"></cite>')).alias("text"))

    def document(real: Column, i: Column) -> Column:
        first = _first_of(notes, F.transform(notes, lambda a: key(a["url"])), real)
        return F.struct(F.concat(F.lit("g-"), i.cast("string")).alias("id"), real.alias("title"), F.coalesce(F.element_at(resolved, first["url"]), F.lit("")).alias("url"), F.lit("").alias("snippet"))

    indexed = keep("__indexed", F.transform(steps, lambda s, i: F.struct(s["type"].alias("type"), s["queries"].alias("queries"), F.coalesce(s["is_error"], F.lit(False)).alias("is_error"), i.alias("i"))))
    searches = keep("__searches", F.filter(indexed, lambda s: s["type"] == "google_search_call"))

    def failed(s: Column, n: Column) -> Column:
        """A failed result before the next search belongs to the call."""
        upto = F.coalesce(F.get(searches, n + 1)["i"], F.size(steps))
        return F.exists(indexed, lambda r: (r["type"] == "google_search_result") & r["is_error"] & (r["i"] > s["i"]) & (r["i"] < upto))

    told = F.struct(
        edited(whole, F.transform(F.array_distinct(F.transform(ends, lambda e: e["end"])), edit).cast(EDITS)).alias("answer"),
        F.transform(keys, document).alias("documents"),
        F.transform(searches, lambda s, n: F.struct(F.concat(F.lit("q"), (n + 1).cast("string")).alias("call_id"), F.array_join(F.coalesce(s["queries"], F.array().cast("array<string>")), " | ").alias("query"), F.when(failed(s, n), "is_error").alias("error"))).alias("calls"),
        F.transform(_parts(steps, "model_output", "text", last, False), lambda c: c["text"]).alias("interim"),
        F.size(notes).alias("citations"),
    )
    return stages.end(told)


def repaired(final: Column, streamed: Column) -> Column:
    """A block's text: what was streamed, where something was and the final message holds another text."""
    return F.when(F.coalesce(streamed, F.lit("")) != "", streamed).otherwise(F.coalesce(final, F.lit("")))
