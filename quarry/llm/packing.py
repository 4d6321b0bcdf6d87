"""Best-fit decreasing packing of documents into fixed-length sequences.

Documents longer than a sequence are first cut into full windows; what is left is placed,
longest first, into the open window that it fills most tightly.  A segment tree indexed by
remaining capacity finds that window.  Only lengths are packed, in partitions of a bounded
number of pieces; token ids never leave the task that made them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import END_ID, encoded, encoder_for
from quarry.llm.workers import tidy
from quarry.storage import materialize

CAPACITY = 2048
#: Pieces that one task packs together; more pieces take more tasks.
PIECES_PER_TASK = 50_000

_PIECES = "doc_id bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint"


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree over the capacities in use."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, window: int) -> None:
        self.windows[remaining].append(window)
        self._count(remaining, 1)

    def _count(self, remaining: int, by: int) -> None:
        node = self.size + remaining
        while node:
            self.tree[node] += by
            node >>= 1

    def take_tightest(self, length: int) -> tuple[int, int] | None:
        """(window, remaining) of the smallest remaining capacity that holds `length`."""
        node = self.size + length
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        remaining = node - self.size
        self._count(remaining, -1)
        return self.windows[remaining].pop(), remaining


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """(window, offset) of each length, given in descending order, and the number of windows."""
    windows, offsets, used, open_ = [], [], 0, OpenWindows(capacity)
    for length in lengths:
        found = open_.take_tightest(length) if length < capacity else None
        window, remaining = found or (used, capacity)
        used += found is None
        windows.append(window)
        offsets.append(capacity - remaining)
        if remaining > length:
            open_.put(remaining - length, window)
    return windows, offsets, used


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document cut at multiples of `capacity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), encoder, end_id), strict=True):
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    for column, value in zip(
                        rows, (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True
                    ):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(tidy(run), _PIECES)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    pieces_per_task: int = PIECES_PER_TASK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Sequences of at most `capacity` ids holding every id of `docs` exactly once.

    A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (gapless from
    0) and offset in the sequence (gapless from 0).  A null text is empty and still has its
    end id.  Repeated or null ids are rows of their own; an empty table gives no piece.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    tasks = max(1, -(-cut.count() // pieces_per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        # The order depends on the rows alone, so a repeated task packs the same way.
        table = table.sort_by([(c, "descending" if c == "length" else "ascending") for c in ("length", *[n for n in table.column_names if n != "length"])])
        windows, offsets, _ = best_fit_decreasing(table.column("length").to_pylist(), capacity)
        n = len(windows)
        table = table.append_column("part", pa.array([TaskContext.get().partitionId()] * n, pa.int64()))
        table = table.append_column("window", pa.array(windows, pa.int64()))
        table = table.append_column("offset", pa.array(offsets, pa.int32()))
        yield from table.to_batches(max_chunksize=10_000)

    dealt = cut.repartition(tasks, F.xxhash64("doc_id", "start", "ids_crc32"))
    packed = materialize(dealt.mapInArrow(tidy(run), _PIECES + ", part bigint, window bigint, offset int"), "packed")
    # One row per packing task.
    counts = packed.groupBy("part").agg((F.max("window") + 1).alias("n")).orderBy("part").collect()
    bases, base = [], 0
    for row in counts:
        bases.append((row["part"], base))
        base += row["n"]
    first = docs.sparkSession.createDataFrame(bases, "part bigint, base bigint")
    return packed.join(F.broadcast(first), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("window")).alias("sequence_id"), "offset"
    )
