"""Tokenisation and a bit-packed file format for token ids.

A file holds ids in fixed-width bit packing, the width being the fewest bits that hold the
vocabulary.  Ids are cut into byte-aligned blocks whose offsets stand in the footer beside
the documents' ids and lengths, so a reader unpacks any block with numpy and reaches any
document directly.  Layout, little-endian:

    b"QTOK1" | width u8 | blocks ... | document ids i64[n] | null flags u8[n] |
    lengths i64[n] | block offsets u64[m] | n u64 | m u64 | ids per block u64 | b"QTOK1"
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.workers import tidy
from quarry.storage import fresh_path

END_ID = 1
BLOCK_IDS = 1 << 16
#: Bytes of text that one file holds, about.
FILE_BYTES = 32 << 20
#: Pieces whose ids a worker remembers, some 40 bytes each; the memory is emptied when full.
CACHE_PIECES = 1_000_000
MAGIC = b"QTOK1"

#: A fixed value: the split pattern of tokenizers that drop white space, so that pieces can be encoded alone.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMALIZERS = {"NFC", "Replace", "Lowercase"}
_WORD_END = "</w>"
_SPACE = r" \t\n\v\f\r"
#: A character on whose lower case and composed form Arrow and the tokenizer may differ: all but white space and those up to U+017F.
_ODD = f"[^{_SPACE}\x21-\x7e\xa1-\u012f\u0131-\u017f]"
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: What `_WORD_PATTERN` splits from the letters around it, in lower-cased text without odd characters.
_APART = f"'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+"
_PIECE = f"^(?:[{_LETTERS}]+|{_APART})$"


class Encoder:
    """Ids of texts.

    Where the tokenizer splits at white space and drops it, a piece's ids do not depend on
    its neighbours: a batch's texts are split into pieces in Arrow, and each worker encodes a
    piece once.  Words with odd characters are encoded whole, and so are the texts of
    other tokenizers and batches with an added token.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = max(vocabulary.values()) + 1
        self.by_word = self._splits_at_space(spec)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self._forget()

    @staticmethod
    def _splits_at_space(spec: dict) -> bool:
        normalizers = (spec.get("normalizer") or {}).get("normalizers", [])
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        return (
            {n["type"] for n in normalizers} == _WORD_NORMALIZERS
            and first.get("type") == "Split"
            and first.get("pattern", {}).get("Regex") == _WORD_PATTERN
            and first.get("behavior") == "Removed"
            and first.get("invert") is True
            and spec["model"].get("end_of_word_suffix") == _WORD_END
            and not any(spec.get(k) for k in ("post_processor", "truncation", "padding"))
            and not any(any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        )

    @property
    def bits(self) -> int:
        return max(1, (self.vocabulary - 1).bit_length())

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _forget(self) -> None:
        self.pieces, self.ids, self.lengths = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int32)

    def _joined(self, pieces: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Ids and their numbers of pieces that are one token run each, many in a call, told apart by their ends."""
        for at in range(0, len(pieces), 1000):
            part = pieces[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and (not len(ids) or ends[-1] == len(ids)):
                yield ids.tobytes(), np.diff(ends, prepend=0)
            else:
                yield self._separate(part)

    def _separate(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        found = self._whole(words)
        return b"".join(found), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _learn(self, missing: pa.Array) -> None:
        single = pc.match_substring_regex(missing, _PIECE)
        rest = missing.filter(pc.invert(single))
        missing = missing.filter(single)
        found = [*self._joined(missing.to_pylist()), self._separate(rest.to_pylist())]
        self.pieces = pa.concat_arrays([self.pieces, missing, rest])
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(x for x, _ in found), "<u4")))
        self.lengths = np.concatenate((self.lengths, *(x for _, x in found)), dtype=np.int32)

    def _places(self, wanted: pa.Array) -> np.ndarray:
        """Where each of the different `wanted` pieces stands among those known; the missing ones are learnt."""
        places = pc.index_in(wanted, value_set=self.pieces)
        if places.null_count:
            missing = wanted.filter(pc.is_null(places))
            if len(self.pieces) + len(missing) > CACHE_PIECES:
                self._forget()
                missing = wanted
            self._learn(missing)
            places = pc.index_in(wanted, value_set=self.pieces)
        return places.to_numpy(zero_copy_only=False)

    @staticmethod
    def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts in a row, and the position at which each text's pieces end."""

        def apart(part: pa.Array) -> pa.Array:
            return pc.replace_substring_regex(pc.utf8_lower(part), f"({_APART})", r" \1 ")

        def stops(lists: pa.Array) -> np.ndarray:
            return lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()

        if not pc.any(pc.match_substring_regex(texts, _ODD)).as_py():
            lists = pc.ascii_split_whitespace(apart(texts))
            return lists.flatten(), stops(lists)
        words = pc.ascii_split_whitespace(texts)
        each = words.flatten()
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(each, _ODD), each, apart(each)))
        return lists.flatten(), np.concatenate(([0], stops(lists)))[stops(words)]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the position at which each text's ids end."""
        if not self.by_word or any(pc.any(pc.match_substring(texts, t)).as_py() for t in self.added):
            found = [np.frombuffer(x, "<u4") for x in self._whole(texts.to_pylist())]
            return np.concatenate(found or [np.zeros(0, "<u4")]), np.cumsum([len(x) for x in found], dtype=np.int64)
        pieces, stops = self._split(texts)
        coded = pieces.dictionary_encode()
        places = self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        after = np.concatenate(([0], np.cumsum(self.lengths[places], dtype=np.int64)))
        known = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(self.lengths)), dtype=np.int32), self.ids)
        return known.take(pa.array(places)).flatten().to_numpy(), after[stops]


@lru_cache(maxsize=1)
def encoder_for(path: str) -> Encoder:
    """The worker process's encoder: what it learnt of pieces in one task serves its next ones."""
    return Encoder(path)


#: Bytes of texts encoded together; one longer text is a batch of its own.
_GROUP_BYTES = 4 << 20


def encoded(column: pa.Array, encoder: Encoder, end_id: int) -> Iterator[np.ndarray]:
    """The ids of every text of an Arrow column, a null as an empty text, with the end id."""
    column = pc.fill_null(column, "")
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    end, at = np.array([end_id], "<u4"), 0
    while at < len(column):
        limit = (int(sizes[at - 1]) if at else 0) + _GROUP_BYTES
        stop = max(at + 1, int(np.searchsorted(sizes, limit, "right")))
        ids, stops = encoder.batch(column.slice(at, stop - at))
        before = 0
        for after in stops.tolist():
            yield np.concatenate((ids[before:after], end))
            before = after
        at = stop


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids in `width` bits each, least significant bit first, padded to a whole byte."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    if width % 8 == 0:
        return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    """The first `n` ids of `pack_bits` output."""
    if width == 16:
        return np.frombuffer(data, "<u2", n).astype("<u4")
    raw = np.frombuffer(data, np.uint8)
    if width % 8 == 0:
        wide = np.zeros((n, 4), np.uint8)
        wide[:, : width // 8] = raw[: n * (width // 8)].reshape(n, -1)
        return wide.reshape(-1).view("<u4")
    bits = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Writes one file; ids are buffered up to one block."""

    def __init__(self, sink, width: int, block_ids: int = BLOCK_IDS) -> None:  # noqa: ANN001
        self.sink, self.width, self.block_ids = sink, width, block_ids
        self.pending: list[np.ndarray] = []
        self.n_pending = 0
        self.offsets: list[int] = []
        self.at = len(MAGIC) + 1
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        sink.write(MAGIC + bytes([width]))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= self.block_ids:
            joined = np.concatenate(self.pending)
            full = len(joined) - len(joined) % self.block_ids
            for a in range(0, full, self.block_ids):
                self._block(joined[a : a + self.block_ids])
            self.pending, self.n_pending = [joined[full:]], len(joined) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.width)
        self.offsets.append(self.at)
        self.at += len(data)
        self.sink.write(data)

    def close(self) -> None:
        if self.n_pending:
            self._block(np.concatenate(self.pending))
        self.sink.write(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        self.sink.write(np.array([x is None for x in self.doc_ids], np.uint8).tobytes())
        self.sink.write(np.array(self.lengths, "<i8").tobytes())
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(struct.pack("<QQQ", len(self.doc_ids), len(self.offsets), self.block_ids) + MAGIC)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source) -> None:  # noqa: ANN001
        self.source = source
        size = source.size()
        n, m, self.block_ids = struct.unpack("<QQQ", self._read(size - 24 - len(MAGIC), 24))
        if self._read(size - len(MAGIC), len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        self.width = self._read(len(MAGIC), 1)[0]
        at = size - 24 - len(MAGIC) - 17 * n - 8 * m
        self.data_end = at
        ids = np.frombuffer(self._read(at, 8 * n), "<i8")
        nulls = np.frombuffer(self._read(at + 8 * n, n), np.uint8)
        self.doc_ids = [None if z else x for x, z in zip(ids.tolist(), nulls.tolist(), strict=True)]
        self.lengths = np.frombuffer(self._read(at + 9 * n, 8 * n), "<i8")
        self.offsets = np.frombuffer(self._read(at + 17 * n, 8 * m), "<u8")
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, b: int) -> np.ndarray:
        start = int(self.offsets[b])
        end = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.data_end
        n = min(self.block_ids, int(self.starts[-1]) - b * self.block_ids)
        return unpack_bits(self._read(start, end - start), self.width, n)

    def document(self, i: int) -> np.ndarray:
        """Ids of document `i` of the file, by reading the blocks that it touches only."""
        a, z = int(self.starts[i]), int(self.starts[i + 1])
        if a == z:
            return np.zeros(0, np.uint32)
        first, last = a // self.block_ids, (z - 1) // self.block_ids
        joined = np.concatenate([self.block(b) for b in range(first, last + 1)])
        return joined[a - first * self.block_ids : z - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, ids) of every document, each block read once."""
        b, held, base = 0, np.zeros(0, np.uint32), 0
        for i, doc_id in enumerate(self.doc_ids):
            a, z = int(self.starts[i]), int(self.starts[i + 1])
            parts = [held[a - base :]]
            have = len(parts[0])
            while have < z - a:
                held, base, b = self.block(b), b * self.block_ids, b + 1
                parts.append(held)
                have += len(held)
            ids = np.concatenate(parts)[: z - a] if len(parts) > 1 else parts[0][: z - a]
            yield doc_id, a, ids


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the token ids of `docs` below `path` in ascending id order; returns the manifest.

    There is a file for about every `file_bytes` bytes of text.

    The manifest (also written, to `path`/manifest) has a row per file: file, part, n_docs,
    n_ids and first_id, the ids in all files before it.  Null texts are empty; null ids come
    first; equal ids are ordered by their texts.  A task names its file anew each time it
    runs, and only files that a finished task reported are in the manifest, so lost
    executors and repeated tasks leave no half-written file behind in it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(size // file_bytes + 1, "id", F.xxhash64("text")).sortWithinPartitions(
        "id", F.xxhash64("text"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name = None, f"{path}/{uuid.uuid4().hex}.qtok"
        for batch in batches:
            if writer is None:
                encoder = encoder_for(tokenizer)
                fs, local = pyarrow.fs.FileSystem.from_uri(name)
                fs.create_dir(os.path.dirname(local), recursive=True)
                sink = fs.open_output_stream(local)
                writer = Writer(sink, encoder.bits)
            ids = encoded(batch.column(1), encoder, end_id)
            for doc_id, one in zip(batch.column(0).to_pylist(), ids, strict=True):
                writer.add(doc_id, one)
        if writer is not None:
            writer.close()
            sink.close()
            row = {
                "file": [name],
                "part": [TaskContext.get().partitionId()],
                "n_docs": [len(writer.doc_ids)],
                "n_ids": [sum(writer.lengths)],
            }
            yield pa.RecordBatch.from_pydict(row)

    # One row per file: the number of partitions bounds it, not the documents.
    files = sorted(ordered.mapInArrow(tidy(run), "file string, part bigint, n_docs bigint, n_ids bigint").collect(), key=lambda r: r["part"])
    rows, before = [], 0
    for f in files:
        rows.append((f["file"], f["part"], f["n_docs"], f["n_ids"], before))
        before += f["n_ids"]
    manifest = spark.createDataFrame(rows, "file string, part bigint, n_docs bigint, n_ids bigint, first_id bigint")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in a manifest's files."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def rows(reader: Reader, first: int) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for doc_id, start, ids in reader.documents():
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            held.append((doc_id, first + start, len(ids), crc, *([ids.astype(np.int64)] if with_ids else [])))
            if len(held) == 4096:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(list(c), pa.int64()) for c in list(zip(*held, strict=True))[:4]]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            columns.append(pa.array([r[4] for r in held], pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, local = pyarrow.fs.FileSystem.from_uri(name)
                with fs.open_input_file(local) as source:
                    yield from rows(Reader(source), first)

    files = manifest.select("file", "first_id")
    # A task per file: the files are few and each is as large as a partition.
    return files.repartitionByRange(max(1, manifest.count()), "first_id").mapInArrow(tidy(run), schema)


def token_files(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Round trip: write the documents' token files to the shared folder and read them back.

    (doc_id, start, n_tokens, ids_crc32) for every row; `start` counts the ids of all
    documents before it.  An empty table gives no file and an empty result.
    """
    spark: SparkSession = docs.sparkSession
    manifest = write_tokens(docs, fresh_path(spark, "tokens"), tokenizer, end_id, id_col, text_col)
    return read_tokens(manifest)
