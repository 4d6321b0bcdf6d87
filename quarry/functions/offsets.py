"""Offsets into texts, and edits at offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDITS = "array<struct<start:int,end:int,text:string>>"


def char_offset(text: Column, byte: Column) -> Column:
    """The character in which a byte of the UTF-8 text lies, counted from 0; the length from its end on, -1 before it."""
    data = text.cast("binary")
    # A text of bytes counts as a character what a first byte begins, cut or not.
    begun = F.length(F.substring(data, F.lit(1), byte.cast("int") + 1).cast("string")) - 1
    return F.when(byte < 0, -1).when(byte >= F.octet_length(text), F.length(text)).otherwise(begun)


def edited(text: Column, edits: Column) -> Column:
    """`text` with each edit's characters [start, end) replaced, from the last (start, end) to the first, equal ones as given.

    `edits` is an array of (start, end, text).  Offsets beyond the text are its end; a null or
    empty array leaves the text.
    """
    given = F.coalesce(edits.cast(EDITS), F.array().cast(EDITS))
    keyed = F.transform(given, lambda e, i: F.struct((-e["start"]).alias("s"), (-e["end"]).alias("e"), i.alias("i"), e["text"].alias("text")))

    def apply(now: Column, e: Column) -> Column:
        start, end = -e["s"], F.greatest(-e["e"], -e["s"])
        return F.concat(F.left(now, start), e["text"], F.substr(now, end + 1))

    return F.aggregate(F.array_sort(keyed), text, apply)
