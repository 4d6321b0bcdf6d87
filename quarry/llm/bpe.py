"""Byte-level BPE by a table of ranks, encoded and decoded by DuckDB queries inside each task.

A batch's texts are split into matches of the pattern, its different matches become
token-position rows, and a recursive query joins neighbouring rows with the table of merges
and contracts every match's leftmost pair of least rank until no match has one.  Decoding
joins the ids with the vocabulary and aggregates the bytes in order.  A worker remembers the
matches it has met, up to a bound, so each is contracted about once.  RE2 splits the texts but for those that hold characters it knows
others of than the pattern's engine.

A match of over ``LONG_MATCH`` bytes contracts all places of its least pair in a step, from
the left and not overlapping.  That is the same as one by one as long as no new pair ranks
below the token it holds; where such a pair turns up, the match goes one by one after all.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.workers import tidy

#: Matches that a worker remembers, about 250 bytes each; when full it forgets those that one batch alone held.
REMEMBERED = 700_000
#: Bytes of text, and of different matches, that one query takes, if a single one has no more.
TEXT_BYTES, MATCH_BYTES = 8 << 20, 1 << 20
LONG_MATCH = 256
#: A fixed value: white space as the pattern's engine knows it, for RE2.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: RE2 cannot look ahead, so this mark, not a character, is set before the last white space of a run ahead of a word.
_MARK = "﷐"
_LOOK_AHEAD = r"\s+(?!\S)|"

_SPLIT = """
SELECT CASE WHEN NOT regexp_matches(text, $odd)
  THEN regexp_extract_all(regexp_replace(text, $run, $marked, 'g'), $pattern) END AS matches FROM texts"""

_LEFTMOST = """
WITH RECURSIVE t(word, pos, id, done) AS (
  SELECT word, pos, id, false FROM word_bytes
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT word, pos, id, id::BIGINT << 32 | lead(id) OVER w AS pair, lead(pos) OVER w AS following
     FROM t WHERE NOT done WINDOW w AS (PARTITION BY word ORDER BY pos)),
   best AS MATERIALIZED (
     SELECT word, min(m.id << 32 | pos) AS least, arg_min(following, m.id << 32 | pos) AS gone
     FROM pairs JOIN merges m USING (pair) GROUP BY word)
   SELECT word, pos, CASE WHEN pos = least & 4294967295 THEN (least >> 32)::INT ELSE id END, least IS NULL
   FROM pairs LEFT JOIN best USING (word) WHERE least IS NULL OR pos <> gone)
) SELECT word, pos, id FROM t WHERE done ORDER BY word, pos"""

_ALL_PLACES = """
WITH RECURSIVE t(word, pos, id, done) AS (
  SELECT word, pos, id, false FROM word_bytes
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT word, pos, id, id::BIGINT << 32 | lead(id) OVER w AS pair, lead(pos) OVER w AS following, row_number() OVER w AS k
     FROM t WHERE NOT done WINDOW w AS (PARTITION BY word ORDER BY pos)),
   found AS MATERIALIZED (SELECT word, pos, following, k, m.id AS merged, m.below FROM pairs JOIN merges m USING (pair)),
   best AS MATERIALIZED (SELECT word, min(merged) AS merged, bool_or(below) AS below FROM found GROUP BY word),
   places AS (
     SELECT word, pos, following, merged, k - row_number() OVER (PARTITION BY word ORDER BY pos) AS run
     FROM found JOIN best USING (word, merged)),
   taken AS MATERIALIZED (
     SELECT word, pos, following, merged FROM places QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1)
   SELECT p.word, p.pos, CASE WHEN b.below THEN -1 ELSE coalesce(c.merged::INT, p.id) END, b.word IS NULL OR b.below
   FROM pairs p LEFT JOIN best b ON b.word = p.word LEFT JOIN taken c ON c.word = p.word AND c.pos = p.pos
   ANTI JOIN taken g ON g.word = p.word AND g.following = p.pos)
) SELECT word, pos, id FROM t WHERE done ORDER BY word, pos"""

_DECODE = "SELECT list(bytes ORDER BY pos) AS bytes FROM ids JOIN vocabulary USING (id)"


@cache
def _classes() -> tuple[dict[str, str], str]:
    """Letters and numbers as the pattern's engine knows them, and the mark with all characters that RE2 sorts otherwise, as classes.

    The engine's tables of Unicode are newer than RE2's and older than those of `regex`.
    """
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    con = duckdb.connect(config={"threads": 1})
    con.register("chars", pa.table({"c": chars}))
    classes, odd = {}, {_MARK}
    for name in (r"\p{L}", r"\p{N}"):
        engine = tiktoken.Encoding("classes", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        held = set(bytes(engine.encode_ordinary("".join(chars))).decode())
        odd |= held ^ {c for (c,) in con.execute("SELECT c FROM chars WHERE regexp_full_match(c, $1)", [name]).fetchall()}
        classes[name] = _ranges(held, r"\U%08x")
    con.close()
    return classes, f"[{_ranges(odd, r'\x{%x}')}]"


@cache
def splitting(pattern: str) -> tuple[tuple[tuple[str, str], ...], str]:
    """Values of the splitting query for a pattern of letters, numbers, white space and the look-ahead, and the pattern for texts with odd characters."""
    classes, odd = _classes()
    core, exact = pattern.replace(_LOOK_AHEAD, ""), pattern
    letters, numbers = classes[r"\p{L}"], classes[r"\p{N}"]
    exact = exact.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    core = core.replace(r"[^\s", f"[^{_MARK}{_SPACE}").replace(r"\s", f"[{_SPACE}]")
    values = {"odd": odd, "run": f"([{_SPACE}])([{_SPACE}][^{_SPACE}])", "marked": rf"\1{_MARK}\2", "pattern": core}
    return tuple(values.items()), exact


def _ranges(chars: set[str], form: str) -> str:
    codes = np.array(sorted(map(ord, chars)))
    return "".join(f"{form % p[0]}-{form % p[-1]}" for p in np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1))


def _gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the slices (start, length), one slice after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Remembered:
    """Ids of matches, as slices of one array, worked out by `learn` for the matches not yet held."""

    def __init__(self, learn: Callable[[list[str]], Iterator[tuple[list[str], np.ndarray, np.ndarray]]]) -> None:
        self.learn = learn
        self.slots: dict[str, int] = {}
        self.starts, self.lengths, self.met = (np.empty(0, np.int64) for _ in range(3))
        self.flat = np.empty(0, np.uint32)

    def _keep_frequent(self) -> None:
        """Forget matches that one batch alone held, or all where that leaves too many."""
        kept = [key for key, slot in self.slots.items() if self.met[slot] > 1]
        kept = kept if len(kept) < REMEMBERED // 2 else []
        old = np.fromiter(map(self.slots.__getitem__, kept), np.int64, len(kept))
        self.flat = self.flat[_gathered(self.starts[old], self.lengths[old])]
        self.lengths, self.met = self.lengths[old], np.zeros(len(old), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.slots = dict(zip(kept, range(len(kept)), strict=True))

    def of(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all matches one after another, and how many each has."""
        coded = keys.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [name for name in names if name not in self.slots]
        if len(self.slots) + len(new) > REMEMBERED:
            self._keep_frequent()
            new = [name for name in names if name not in self.slots]
        for learnt, flat, lengths in self.learn(new) if new else ():
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.met = np.concatenate([self.met, np.zeros(len(learnt), np.int64)])
            self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
            self.slots.update(zip(learnt, range(len(self.slots), len(self.slots) + len(learnt)), strict=True))
        slots = np.fromiter(map(self.slots.__getitem__, names), np.int64, len(names))
        self.met[slots] += 1
        slots = slots[coded.indices.to_numpy()]
        lengths = self.lengths[slots]
        return self.flat[_gathered(self.starts[slots], lengths)], lengths


class Codec:
    """Ids of texts and bytes of ids by the ranks in a file of base64 tokens and their ranks."""

    def __init__(self, path: str, split: tuple[tuple[str, str], ...], exact: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.split, self.pattern = dict(split), regex.compile(exact)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        pairs = [(a << 32 | b, rank, rank <= max(a, b)) for token, rank in self.ranks.items() for a, b in self._halves(token)]
        kinds = {"pair": pa.int64(), "id": pa.int64(), "below": pa.bool_()}
        merges = pa.table({name: pa.array([p[k] for p in pairs], kind) for k, (name, kind) in enumerate(kinds.items())})
        vocabulary = pa.table({"id": list(self.ranks.values()), "bytes": list(self.ranks)})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("rows_of", rows)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_of")
            self.con.unregister("rows_of")
        self.remembered = _Remembered(self._encode_matches)

    def _halves(self, token: bytes) -> Iterator[tuple[int, int]]:
        for cut in range(1, len(token)):
            a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if a is not None and b is not None:
                yield a, b

    def _ask(self, sql: str, name: str, rows: pa.Table, **values: str) -> pa.Table:
        self.con.register(name, rows)
        try:
            return self.con.sql(sql, params=values).to_arrow_table()
        finally:
            self.con.unregister(name)

    def _matches(self, texts: pa.Array) -> pa.ListArray:
        found = self._ask(_SPLIT, "texts", pa.table({"text": texts}), **self.split)["matches"].combine_chunks()
        missed = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        if not len(missed):
            return found
        others = pa.array([self.pattern.findall(t) for t in texts.take(pa.array(missed)).to_pylist()], found.type)
        at = np.arange(len(texts))
        at[missed] = len(texts) + np.arange(len(missed))
        return pa.concat_arrays([found, others]).take(pa.array(at))

    def _contract(self, matches: list[str], sql: str) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        words = [m.encode() for m in matches]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for part in _parts(sizes, MATCH_BYTES):
            n = sizes[part]
            begins = np.cumsum(n) - n
            ids = self.byte_ids[np.frombuffer(b"".join(words[part]), np.uint8)]
            rows = {"word": np.repeat(np.arange(len(n)), n), "pos": np.arange(len(ids)) - np.repeat(begins, n), "id": ids}
            done = self._ask(sql, "word_bytes", pa.table({k: v.astype(np.int32) for k, v in rows.items()}))
            yield matches[part], done["id"].to_numpy(), np.bincount(done["word"].to_numpy(), minlength=len(n))

    def _encode_matches(self, matches: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        whole = [(m, self.ranks[m.encode()]) for m in matches if m.encode() in self.ranks]
        yield [m for m, _ in whole], np.array([i for _, i in whole], np.int64), np.ones(len(whole), np.int64)
        held = {m for m, _ in whole}
        short = [m for m in matches if m not in held and len(m.encode()) <= LONG_MATCH]
        for long in (m for m in matches if m not in held and len(m.encode()) > LONG_MATCH):
            ((_, ids, lengths),) = self._contract([long], _ALL_PLACES)
            if ids[0] < 0:
                short.append(long)
            else:
                yield [long], ids, lengths
        yield from self._contract(short, _LEFTMOST)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin and the last one's end."""
        matches = self._matches(texts.cast(pa.string()))
        ids, lengths = self.remembered.of(matches.flatten())
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[matches.offsets.to_numpy() - matches.offsets[0].as_py()]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of the ids between every two bounds."""
        if not len(ids):
            return [b""] * (len(bounds) - 1)
        rows = pa.table({"pos": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int64)})
        pieces = self._ask(_DECODE, "ids", rows)["bytes"].combine_chunks().flatten().cast(pa.large_binary())
        if len(pieces) < len(ids):
            raise ValueError("an id is not in the vocabulary")
        _, offsets, data = pieces.buffers()
        at = np.frombuffer(offsets, np.int64)[pieces.offset + bounds].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(at, at[1:])]  # noqa: B905


@lru_cache(1)
def codec(path: str, split: tuple[tuple[str, str], ...], exact: str) -> Codec:
    """The process's codec, so that what it remembers outlives a task."""
    return Codec(path, split, exact)


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive rows of at most so many bytes together, or a single larger one."""
    begun, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield slice(begun, i)
            begun, total = i, 0
        total += size
    if begun < len(sizes):
        yield slice(begun, len(sizes))


def _texts(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_string()).fill_null("")


def _table(docs: DataFrame, id_col: str, text_col: str, kind: str = "string") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast(kind).alias("value"))


def _by_part(batch: pa.RecordBatch, values: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    sizes = np.nan_to_num(pc.binary_length(values).to_numpy(zero_copy_only=False))
    for part in _parts(sizes, TEXT_BYTES):
        yield batch.column(0)[part], values[part]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of `docs`; ids are little-endian unsigned 32-bit integers in one binary value.

    A null or empty text has no ids, and null or repeated ids of documents keep a row each.
    Other columns, whatever their names, are not looked at.  A text is encoded whole, however
    long, in the memory of one task; an empty table gives an empty result.
    """
    split, exact = splitting(pattern)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, split, exact)
        for batch in batches:
            for names, texts in _by_part(batch, _texts(batch.column(1))):
                ids, bounds = own.encode(texts)
                data = pa.array([ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())  # noqa: B905
                yield pa.RecordBatch.from_arrays([names, pa.array(np.diff(bounds)), data], ["doc_id", "n_tokens", "ids"])

    source = _table(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) for every row of `encoded`, whose ids are as `encode` gives them; decoded is binary.

    Null ids give no bytes.  An id outside the vocabulary fails the query.
    """
    split, exact = splitting(pattern)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, split, exact)
        for batch in batches:
            for names, values in _by_part(batch, batch.column(1).cast(pa.large_binary()).fill_null(b"")):
                held = values.to_pylist()
                bounds = np.concatenate([[0], np.cumsum([len(v) // 4 for v in held])]).astype(np.int64)
                decoded = own.decode(np.frombuffer(b"".join(held), "<u4"), bounds)
                yield pa.RecordBatch.from_arrays([names, pa.array(decoded, pa.binary())], ["doc_id", "decoded"])

    source = _table(encoded, id_col, ids_col, "binary")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of `docs`: `encode`, then `decode` of its ids, in one pass.

    Nulls, repeated rows, long texts and empty tables as in `encode`.
    """
    split, exact = splitting(pattern)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, split, exact)
        for batch in batches:
            for names, texts in _by_part(batch, _texts(batch.column(1))):
                ids, bounds = own.encode(texts)
                data = np.ascontiguousarray(ids, "<u4")
                told = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])]  # noqa: B905
                back = [hashlib.sha256(value).hexdigest() for value in own.decode(ids, bounds)]
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(np.diff(bounds)), pa.array(told, pa.string()), pa.array(back, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    source = _table(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
