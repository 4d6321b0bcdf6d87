"""Nested documents of unknown shape: records of either root, flattening, key stripping, redaction."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import norm, strip
from quarry.storage import materialize


def _is(node: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(node), F.lit(kind)), F.lit(False))


def _read(node: Column, kind: str) -> Column:
    """The variant as a type, null where it is another; a cast would fail there, even behind a condition."""
    return F.try_variant_get(node, "$", kind)


def records(document: Column, name: str) -> Column:
    """The records of a document as an array of variants: its elements, those of its array `name`, or else itself.

    No valid JSON, or a null, has no record.
    """
    root = F.try_parse_json(document)
    inner = F.try_variant_get(root, f"$.{name}", "variant")
    none = F.array().cast("array<variant>")
    return F.when(_is(root, "ARRAY"), _read(root, "array<variant>")).when(_is(inner, "ARRAY"), _read(inner, "array<variant>")).when(_is(root, "OBJECT"), F.array(root)).otherwise(none)


def proposals(elements: Column, field: str, n: int) -> Column:
    """The first n texts of an array of variants that are texts or objects with a text `field`.

    Blank ones and those said before (in any case, white space aside) take no place; other elements are passed over.
    """
    def text(v: Column) -> Column:
        named = F.when(_is(v, "OBJECT"), F.try_variant_get(v, f"$.{field}", "variant"))
        return F.coalesce(F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string")), F.when(_is(named, "STRING"), F.try_variant_get(named, "$", "string")))

    texts = F.filter(F.transform(elements, lambda v: strip(text(v))), lambda t: t.isNotNull() & (t != ""))
    keys = F.transform(texts, norm)
    return F.slice(F.filter(texts, lambda t, i: F.array_position(keys, F.get(keys, i)) == i + 1), 1, n)


def leaves(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, value) of each value of the JSON objects in `document`, the keys to it joined by dots; value is a variant.

    A list is one value, an empty object none, and a root that is no object none.  One round
    for each level of the deepest object.
    """
    level = rows.select(F.col(key), F.lit(None).cast("string").alias("path"), F.try_parse_json(document).alias("value"))
    level, found = level.filter(_is(F.col("value"), "OBJECT")), []
    while not level.isEmpty():
        opened = level.select(key, "path", F.explode(_read(F.col("value"), "map<string,variant>")).alias("name", "value"))
        below = materialize(opened.select(key, F.concat_ws(".", "path", "name").alias("path"), "value"), "level")
        found.append(below.filter(~_is(F.col("value"), "OBJECT")))
        level = below.filter(_is(F.col("value"), "OBJECT"))
    return reduce(DataFrame.unionByName, found) if found else level


def overrides(found: DataFrame) -> DataFrame:
    """`leaves` as one override a row: texts with a space or = or nothing in quotes, lists of values in brackets."""
    value = F.col("value")

    def python(v: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        return F.when(_is(v, "VOID") | v.isNull(), "None").when(_is(v, "BOOLEAN"), F.initcap(text)).when(_is(v, "STRING"), text).otherwise(F.to_json(v))

    text = F.try_variant_get(value, "$", "string")
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    shown = (
        F.when(_is(value, "ARRAY"), F.concat(F.lit("["), F.array_join(F.transform(_read(value, "array<variant>"), python), ","), F.lit("]")))
        .when(_is(value, "VOID"), "null")
        .when(_is(value, "STRING") & (text.contains(" ") | text.contains("=") | (text == "")), quoted)
        .when(_is(value, "STRING"), text)
        .otherwise(F.to_json(value))
    )
    return found.withColumn("override", F.concat(F.col("path"), F.lit("="), shown)).drop("value")


def without_keys(document: Column, keys: tuple[str, ...], bare_types: tuple[str, ...] = ()) -> Column:
    """The JSON text without these keys at any depth; an object whose `type` is one of `bare_types` keeps nothing else.

    Spark's variants can be read but not edited at any depth, so this is a walk over the parsed
    text, in batches.  Null stays null, and what is no JSON stays as it is.
    """
    def walk(node: object) -> object:
        if isinstance(node, dict):
            if isinstance(node.get("type"), str) and node["type"] in bare_types:
                return {"type": node["type"]}
            return {name: walk(value) for name, value in node.items() if name not in keys}
        return [walk(value) for value in node] if isinstance(node, list) else node

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(walk(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return text

    @F.pandas_udf("string")
    def strip_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(one, na_action="ignore")

    return strip_all(document)


def redacted(body: Column) -> Column:
    """A JSON object without its `answer` and `trace`, with answer_chars and trace_present where it had them; other roots as they are."""
    root = F.try_parse_json(body)
    fields = _read(root, "map<string,variant>")
    none = F.create_map().cast("map<string,variant>")
    chars = F.coalesce(F.length(F.try_variant_get(root, "$.answer", "string")), F.lit(0))
    present = ~_is(F.try_variant_get(root, "$.trace", "variant"), "VOID")
    size = F.when(F.map_contains_key(fields, "answer"), F.create_map(F.lit("answer_chars"), chars.cast("variant"))).otherwise(none)
    trace = F.when(F.map_contains_key(fields, "trace"), F.create_map(F.lit("trace_present"), present.cast("variant"))).otherwise(none)
    kept = F.map_filter(fields, lambda k, _: ~k.isin("answer", "trace", "answer_chars", "trace_present"))
    return F.when(_is(root, "OBJECT"), F.to_json(F.map_concat(kept, size, trace))).otherwise(body)
