"""Benchmark decontamination with a generalised suffix automaton over words.

The items' word sequences build one automaton; a document's words are streamed through it
while the length of the longest match ending at each word is tracked.  Ten matched words
are a window of some item; a shorter item is a window as a whole.  Items are taken in
blocks of bounded size, one automaton each, and the documents pass through the blocks one
after another without a shuffle, through a few of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.workers import tidy
from quarry.storage import materialize

WINDOW = 10
#: Words of the items that one automaton holds; a state takes a few hundred bytes.
BLOCK_WORDS = 100_000

#: Lower-cases A-Z and turns every byte that is not of a word into a space.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, lower-cased ASCII letters and characters from U+0080."""
    return text.translate(_PLAIN).split() if text else []


class SuffixAutomaton:
    """Suffix automaton of several word sequences, each started again at the root."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(name, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for name, ws in items if ws]
        self.shortest = min([window, *(len(s) for _, s in sequences)])
        for _, seq in sequences:
            last = 0
            for symbol in seq:
                last = self._extend(last, symbol)
        #: Names of the items whose window ends in a state (at the window's length).
        self.full: dict[int, set[str | None]] = {}
        #: Whole items of fewer words than a window, by state: (words, names).
        self.short: dict[int, tuple[int, set[str | None]]] = {}
        for name, seq in sequences:
            for at in range(max(1, len(seq) - window + 1)):
                part, state = seq[at : at + window], 0
                for symbol in part:
                    state = self.next[state][symbol]
                if len(part) == window:
                    self.full.setdefault(state, set()).add(name)
                else:
                    self.short.setdefault(state, (len(part), set()))[1].add(name)

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state of p's longest string and `symbol`: q, or a clone of q where q holds longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol, self.next[last][symbol])
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, symbol, self.next[p][symbol])
        return state

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Hit spans [from, to) in ascending order, disjoint, and the names of the items they come from."""
        spans: list[tuple[int, int]] = []
        names: set[str | None] = set()
        codes = np.fromiter(map(self.ids.get, ws, [-1] * len(ws)), np.int64, len(ws))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        starts, ends = known[::2], known[1::2]
        long_enough = ends - starts >= self.shortest
        for start, end in zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True):
            self._stream(codes[start:end].tolist(), start, spans, names)
        return spans, names

    def _stream(self, codes: list[int], base: int, spans: list[tuple[int, int]], names: set[str | None]) -> None:
        following, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for at, symbol in enumerate(codes, base + 1):
            while state and symbol not in following[state]:
                state = link[state]
                matched = length[state]
            if symbol in following[state]:
                state, matched = following[state][symbol], matched + 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = min(matched, length[state])
                names |= self.full[state]
                self._mark(spans, at - window, at)
            if self.short:
                s = state
                while s > 0:
                    if s in self.short and self.short[s][0] <= matched:
                        names |= self.short[s][1]
                        self._mark(spans, at - self.short[s][0], at)
                    s = link[s]

    @staticmethod
    def _mark(spans: list[tuple[int, int]], start: int, end: int) -> None:
        while spans and spans[-1][1] >= start:
            start, end = min(start, spans[-1][0]), max(end, spans[-1][1])
            spans.pop()
        spans.append((start, end))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple]]:
    """The items' (name, words), streamed to the driver in blocks of about `block_words` words."""
    block, size = [], 0
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    for row in rows.filter(F.col("text").isNotNull()).toLocalIterator():
        ws = words(bytes(row["text"]))
        block.append((row["id"], ws))
        size += len(ws)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


_SPANS = "array<struct<start:int,end:int>>"
#: Automata handed to the tasks of one pass over the documents; beyond, what was found is written and the next ones follow.
BLOCKS_AT_ONCE = 8
_FOUND = ("__n_words", "__spans", "__items")


def _searched(
    docs: DataFrame, items: DataFrame, window: int, block_words: int, text_col: str, item_id_col: str, item_text_col: str
) -> tuple[DataFrame, object]:
    """`docs` with the columns of `_FOUND` (words, hit spans, items) by all blocks but the last, and that one's automaton."""
    names = _free_names(docs.columns)
    kinds = ("bigint", _SPANS, "array<string>")
    starts = (F.lit(0), F.array(), F.array())
    current = docs.withColumns({n: s.cast(k) for n, s, k in zip(names, starts, kinds, strict=True)})
    sc, held = docs.sparkSession.sparkContext, []
    blocks = item_blocks(items, item_id_col, item_text_col, block_words)
    for block in chain([next(blocks, [])], blocks):
        if len(held) > BLOCKS_AT_ONCE:
            current = materialize(current, "decontamination")
            for one in held[:-1]:
                one.unpersist()
            held = held[-1:]
        if held:
            current = _through(current, held[-1], text_col, names)
        held.append(sc.broadcast(SuffixAutomaton(block, window)))
    return current, held[-1]


def _free_names(columns: list[str]) -> list[str]:
    """`_FOUND`, lengthened until no column has such a name."""
    taken, tail = {c.lower() for c in columns}, ""
    while any(n + tail in taken for n in _FOUND):
        tail += "_"
    return [n + tail for n in _FOUND]


def hit_spans(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, text, n_words, spans, items) for every row of `docs`; `spans` are word positions."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found, last = _searched(narrow, items, window, block_words, "text", item_id_col, item_text_col)
    found = _through(found, last, "text", list(_FOUND))
    return found.withColumnsRenamed(dict(zip(_FOUND, ("n_words", "spans", "items"), strict=True)))


def _through(docs: DataFrame, automaton, text_col: str, names: list[str]) -> DataFrame:  # noqa: ANN001
    schema = docs.schema
    at = [docs.columns.index(c) for c in (text_col, *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: SuffixAutomaton = automaton.value
        for batch in batches:
            counts, spans, items = [], [], []
            before = zip(batch.column(at[2]).to_pylist(), batch.column(at[3]).to_pylist(), strict=True)
            for text, (old_spans, old_names) in zip(batch.column(at[0]).cast(pa.binary()), before, strict=True):
                ws = words(text.as_py())
                found, new_names = one.match(ws)
                counts.append(len(ws))
                if old_spans:
                    found = merge_spans(found + [(s["start"], s["end"]) for s in old_spans])
                spans.append([{"start": a, "end": b} for a, b in found])
                items.append(sorted(set(old_names) | {n for n in new_names if n is not None}))
            columns = list(batch.columns)
            for place, values in zip(at[1:], (counts, spans, items), strict=True):
                columns[place] = pa.array(values, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, **names: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of `docs`.

    A null text has no words and no hits; an item without words has no window.  An item
    without an id still hits but is not counted; repeated items count once by id.  Documents
    with repeated ids are answered one by one; empty tables give empty or clean results.
    """
    found = hit_spans(docs, items, window, **names)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of `spans` and what lies between the words of one span."""
    data = text.encode("utf-8", "replace")
    plain, keep, at, position = data.translate(_PLAIN), [], 0, 0
    ws = plain.split()
    pieces = []
    for w in ws:
        start = plain.index(w, position)
        position = start + len(w)
        pieces.append((start, position))
    for a, b in spans:
        keep.append(data[at : pieces[a][0]])
        at = pieces[b - 1][1]
    keep.append(data[at:])
    return b"".join(keep).decode("utf-8", "replace")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """`docs` without benchmark spans: hit words are cut out, with the columns of `docs`.

    A document goes as a whole where more than `max_coverage` of its words are hit.  Null
    texts and documents without a hit stay as they are.
    """
    found, last = _searched(docs, items, window, block_words, text_col, item_id_col, item_text_col)
    schema = docs.schema
    position, spans_at = docs.columns.index(text_col), found.columns.index(_free_names(docs.columns)[1])

    # The last block is searched where the text is cut, so one Python worker a task does both.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: SuffixAutomaton = last.value
        for batch in batches:
            kept, texts = [], []
            for text, hit in zip(batch.column(position), batch.column(spans_at).to_pylist(), strict=True):
                text = text.as_py()
                ws = words(text.encode("utf-8", "replace") if text else None)
                spans = merge_spans(one.match(ws)[0] + [(s["start"], s["end"]) for s in hit])
                kept.append(not spans or sum(b - a for a, b in spans) <= max_coverage * len(ws))
                texts.append(remove_spans(text, spans) if spans and kept[-1] else text)
            columns = list(batch.columns[: len(schema)])
            columns[position] = pa.array(texts, batch.schema.field(position).type)
            out = pa.RecordBatch.from_arrays(columns, names=schema.names)
            yield out.filter(pa.array(kept, pa.bool_()))

    return found.mapInArrow(tidy(run), schema)
