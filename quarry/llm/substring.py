"""Substring deduplication over sliding runs of sentences.

For every sentence of every document two runs of consecutive sentences are hashed: the
shortest that starts and the shortest that ends with it and has at least two sentences and
`min_words` words.  Every longer run is made of these, so whatever such sentences two texts
share is covered from its first to its last.  A sentence that is long enough by itself is
hashed alone too.  Runs are counted by hash over the whole corpus, the first place (by
document id and position) of a repeated run stays, and sentences covered by any later place
are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.workers import tidy
from quarry.storage import materialize

MIN_WORDS = 25
#: Words from which one sentence is a run by itself.
LONG_SENTENCE = 50
#: Tasks over which the places of one run are spread.
SALTS = 8
#: Texts with a repeated run (12 bytes each) up to which the others stay where they are; beyond, all are shuffled.
BROADCAST_TEXTS = 5_000_000
_SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?]+(?=\S)[^\n.!?]*)*(?:[.!?]+\s*|\n\s*|$)")
_LEAST = -(1 << 63)


def sentences(text: str) -> list[str]:
    """The text cut after sentence ends and line ends; the pieces joined are the text."""
    return [s for s in _SENTENCE.findall(text) if s]


def runs(parts: list[str], min_words: int, long_sentence: int) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, sentences, normalised text) of every hashed run; blank pieces are skipped over."""
    ws = [p.lower().split() for p in parts]
    full = [i for i, w in enumerate(ws) if w]
    texts = [" ".join(ws[i]).encode("utf-8", "replace") for i in full]
    counts = [len(ws[i]) for i in full]
    n = len(full)
    for k in range(n):
        if counts[k] >= long_sentence or n == 1 and counts[k] >= min_words:
            yield full[k], 1, texts[k]
    end, total, ends = 0, 0, []
    for k in range(n):
        while end < n and (end - k < 2 or total < min_words):
            total += counts[end]
            end += 1
        ends.append(end if end - k >= 2 and total >= min_words else n + 1)
        if ends[k] <= n:
            yield full[k], full[end - 1] - full[k] + 1, b"\n".join(texts[k:end])
        total -= counts[k]
    start, total = 0, 0
    for end in range(1, n + 1):
        total += counts[end - 1]
        while end - start > 2 and total - counts[start] >= min_words:
            total -= counts[start]
            start += 1
        if end - start >= 2 and total >= min_words and ends[start] != end:
            yield full[start], full[end - 1] - full[start] + 1, b"\n".join(texts[start:end])


def _spans(docs: DataFrame, min_words: int, long_sentence: int) -> DataFrame:
    """(h1, h2, id, tag, place) of `docs(id, tag, text)`; place packs the run's length and its first sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, row, places = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if not text:
                    continue
                for first, n, data in runs(sentences(text), min_words, long_sentence):
                    digest = xxhash.xxh3_128_intdigest(data)
                    h1.append(digest >> 64)
                    h2.append(digest & 0x7FFFFFFF)
                    row.append(i)
                    places.append(n << 32 | first)
            at = pa.array(row, pa.int32())
            arrays = [
                pa.array(np.array(h1, np.uint64).view(np.int64)),
                pa.array(h2, pa.int32()),
                batch.column(0).take(at),
                batch.column(1).take(at),
                pa.array(places, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "id", "tag", "place"])

    return docs.select("id", "tag", "text").mapInArrow(tidy(run), "h1 bigint, h2 int, id bigint, tag int, place bigint")


def covered(places: list[dict], n: int) -> set[int]:
    """Sentences, of n, in the places that are removed: where `run` is given, all but the run's first place."""
    found: set[int] = set()
    first: dict[int, int] = {}
    for p in places:
        if p["run"] is not None:
            first[p["run"]] = min(first.get(p["run"], p["place"]), p["place"])
    for p in places:
        if p["run"] is None or p["place"] != first[p["run"]]:
            start, length = p["place"] & 0xFFFFFFFF, p["place"] >> 32
            found.update(range(start, min(n, start + length)))
    return found


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, long_sentence: int = LONG_SENTENCE) -> DataFrame:
    """(id, tag, places): every place of a repeated run of `docs(id, tag, text)`.

    A place in the run's first document carries the `run`, as only later ones there go.
    """
    # Salted, so that no run's places meet in one task; the count's partial sums need no salt.
    salt = F.pmod(F.xxhash64("id", "tag"), F.lit(SALTS)).cast("int")
    spans = _spans(docs, min_words, long_sentence).withColumn("salt", salt).repartition("h1", "h2", "salt")
    # One number orders texts by id and tag, so the least is found by hashing and not by sorting.
    text = F.col("id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("tag").cast("decimal(11,0)")
    first = spans.groupBy("h1", "h2").agg(F.min(text).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    dealt = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = spans.join(dealt, ["h1", "h2", "salt"])
    place = F.struct("place", F.when(text == F.col("first"), F.col("h1")).alias("run"))
    return joined.groupBy("id", "tag").agg(F.collect_set(place).alias("places"))


def dedup_substrings(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    long_sentence: int = LONG_SENTENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed) for every row of `docs`.

    The text keeps every sentence that no later place of a repeated run covers, white space
    included.  Null texts stay null and have no sentence; documents without a repeated run
    are unchanged.  A null id orders first, equal ids by a hash of their texts.  Rows that
    agree in id and text are one place, so none of them is removed on account of another.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST)).alias("id"),
        F.hash(F.col(text_col)).alias("tag"),
        F.col(text_col).alias("text"),
    )
    later = materialize(repeated_spans(rows.select("id", "tag", "text"), min_words, long_sentence), "repeated-places")
    touched = later.select("id", "tag")
    if touched.count() <= BROADCAST_TEXTS:
        # Only the texts that lose a sentence meet their places; the others are not moved.
        some = rows.join(F.broadcast(touched), ["id", "tag"], "left_semi").join(later.hint("merge"), ["id", "tag"])
        rest = rows.join(F.broadcast(touched), ["id", "tag"], "left_anti").withColumn("places", F.lit(None).cast(later.schema["places"].dataType))
        joined = some.unionByName(rest)
    else:
        joined = rows.join(later, ["id", "tag"], "left")
    joined = joined.select("doc_id", "text", "places")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = sentences(text) if text else []
                gone = covered(places, len(parts)) if places and text else set()
                texts.append("".join(p for i, p in enumerate(parts) if i not in gone) if gone else text)
                counts.append(len(parts))
                removed.append(len(gone))
            arrays = [
                batch.column(0),
                pa.array(texts, batch.schema.field(1).type),
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_sentences", "n_removed"])

    return joined.mapInArrow(tidy(run), f"doc_id {kind}, text string, n_sentences bigint, n_removed bigint")
