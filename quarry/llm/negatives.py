"""Hard negatives by distributed radix selection.

Vectors are kept in chunks and the anchors in blocks, as matrices of integers; every chunk
meets every block, and the scores of a pair are one matrix product in a task.  A window is a
range of scores of one anchor of which the first k rows are sought.  Each pass counts the
rows of the still open windows by the next digit of their score, the counts are summed over
the chunks, and the bucket of the kth row is where the next pass goes on; a window whose kth
score has more rows than places goes on by the digits of their ids.  Only then are the rows
gathered that the cuts let through, k a window, so no pass moves more than counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.workers import tidy
from quarry.storage import materialize

#: Rows of a chunk, anchors of a block, and bits of a digit.
CHUNK_ROWS, BLOCK_ANCHORS, DIGIT_BITS = 4096, 1024, 16
#: Blocks that a partition of the anchors holds.
BLOCKS_A_PART = 16
_LONG = np.iinfo(np.int64)
_MATRIX = "ids binary, labels binary, dim int, data binary"


def _matrices(rows: DataFrame, scale: float, size: int) -> DataFrame:
    """(ids, labels, dim, data): up to `size` rows of (vec_id, label, vector) as matrices of floor(scale * x), shorter vectors ending in zeros.

    Vectors with a null or non-finite component are left out; an integer beyond a long's range is its end.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                ids, labels, vectors = batch.slice(at, size).columns
                lengths = np.diff(vectors.offsets.to_numpy())
                flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
                row = np.repeat(np.arange(len(lengths)), lengths)
                with np.errstate(over="ignore"):
                    whole = np.floor(scale * flat)
                bad = np.zeros(len(lengths), bool)
                bad[row[~np.isfinite(flat)]] = True
                data = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
                column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                near = np.clip(np.nan_to_num(whole), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
                data[row, column] = np.where(np.nan_to_num(whole) >= 2.0**63, _LONG.max, near)
                if not bad.all():
                    values = [ids.to_numpy()[~bad], labels.to_numpy()[~bad], data.shape[1], data[~bad]]
                    yield pa.RecordBatch.from_pylist([{"ids": values[0].astype("<i8").tobytes(), "labels": values[1].astype("<i8").tobytes(), "dim": values[2], "data": values[3].astype("<i8").tobytes()}], pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("dim", pa.int32()), ("data", pa.binary())]))

    return rows.mapInArrow(run, _MATRIX)


def _read(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}_ids"], "<i8")
    return ids, np.frombuffer(row[f"{prefix}_labels"], "<i8"), np.frombuffer(row[f"{prefix}_data"], "<i8").reshape(len(ids), row[f"{prefix}_dim"])


def _scores(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products as longs: by floats where these are exact, else by Python's integers, ending at a long's range."""
    dim = min(a.shape[1], r.shape[1])
    a, r = a[:, :dim], r[:, :dim]
    most = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (a, r)]
    if dim * most[0] * most[1] < 2**53:
        return (a.astype(np.float64) @ r.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ r.T.astype(object) if dim else np.zeros((len(a), len(r)), object)
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


class _Pair:
    """The rows of a chunk that fall into the windows of a block, as (window, score, id)."""

    def __init__(self, row: dict, same: bool) -> None:
        anchors, labels, a = _read(row, "a")
        ids, others, r = _read(row, "r")
        self.windows = {name: np.array([w[name] for w in row["windows"]], np.int64) for name in ("w", "a", "low", "top", "need", "phase", "shift", "prefix_shift", "prefix", "cut", "id_cut")}
        of = self.windows["a"]
        score = _scores(a, r)
        least, most = np.full(len(anchors), _LONG.max), np.full(len(anchors), _LONG.min)
        np.minimum.at(least, of, self.windows["low"])
        np.maximum.at(most, of, self.windows["top"])
        fits = (score >= least[:, None]) & (score <= most[:, None]) & ((labels[:, None] == others[None, :]) == same)
        if same:
            fits &= anchors[:, None] != ids[None, :]
        anchor, at = np.nonzero(fits)
        found, names = score[anchor, at], ids[at]
        order = np.argsort(of, kind="stable")
        begins, ends = np.searchsorted(of[order], [np.arange(len(anchors)), np.arange(len(anchors)) + 1])
        parts = []
        for k in range(int((ends - begins).max(initial=0))):  # an anchor has a window or k of them
            chosen = np.flatnonzero((begins + k < ends)[anchor])
            window = order[(begins + k)[anchor[chosen]]]
            inside = (found[chosen] >= self.windows["low"][window]) & (found[chosen] <= self.windows["top"][window])
            parts.append((window[inside], found[chosen][inside], names[chosen][inside]))
        self.window, self.score, self.id = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(3))

    def of(self, name: str) -> np.ndarray:
        return self.windows[name][self.window]

    def counts(self) -> list[np.ndarray]:
        """Window, bucket and rows of it; a window's buckets end where this chunk alone fills its places."""
        by_id = self.of("phase") == 1
        key = np.where(by_id, self.id, ~self.score)
        started = self.of("prefix_shift") < 64
        kept = ~by_id | (self.score == self.of("cut"))
        kept &= ~started | (key >> np.minimum(self.of("prefix_shift"), 63) == self.of("prefix"))
        kept &= self.of("phase") < 2
        window, bucket = self.window[kept], (key >> self.of("shift"))[kept]
        order = np.lexsort((bucket, window))
        window, bucket = window[order], bucket[order]
        first = np.flatnonzero(np.append(True, (np.diff(window) != 0) | (np.diff(bucket) != 0))) if len(window) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(window)))
        window, bucket = window[first], bucket[first]
        earlier = np.cumsum(n) - n
        earlier -= earlier[np.searchsorted(window, window)] if len(window) else 0
        needed = earlier < self.windows["need"][window]
        return [self.windows["w"][window[needed]], bucket[needed], n[needed]]

    def gathered(self, k: int) -> list[np.ndarray]:
        """Window, id and score of the rows that the cuts let through, k a window at most."""
        passed = (self.score > self.of("cut")) | ((self.score == self.of("cut")) & (self.id <= self.of("id_cut")))
        window, score, ids = self.window[passed], self.score[passed], self.id[passed]
        order = np.lexsort((ids, ~score, window))
        window, score, ids = window[order], score[order], ids[order]
        place = np.arange(len(window)) - np.searchsorted(window, window)
        return [self.windows["w"][window[place < k]], ids[place < k], score[place < k]]


def _over_pairs(chunks: DataFrame, blocks: DataFrame, windows: DataFrame, same: bool, k: int | None, names: list[str]) -> DataFrame:
    """(block, w, ...) of every chunk with every block and its windows: counts, or the rows gathered if there is a k.

    The anchors are the stated query set, and blocks of them, not rows, meet the chunks.
    """
    state = windows.groupBy("block").agg(F.collect_list(F.struct([c for c in windows.columns if c != "block"])).alias("windows"))
    anchors = blocks.join(state, "block").select("block", "windows", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "dim", "data")])
    # Every partition of the anchors meets every partition of the chunks, so there are only as many as hold some blocks each.
    anchors = anchors.coalesce(max(1, blocks.count() // BLOCKS_A_PART))
    pairs = chunks.select(*[F.col(c).alias(f"r_{c}") for c in ("ids", "labels", "dim", "data")]).crossJoin(anchors)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                pair = _Pair(row, same)
                found = pair.counts() if k is None else pair.gathered(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), row["block"])), *map(pa.array, found)], ["block", "w", *names])

    return pairs.mapInArrow(run, f"block bigint, w bigint, {names[0]} bigint, {names[1]} bigint")


def _bits(least: int, most: int) -> int:
    """The first shift at which the integers of a range have one digit."""
    shift = 0
    while (most >> shift) - (least >> shift) >= 1 << DIGIT_BITS:
        shift += 1
    return shift


def _first(chunks: DataFrame, blocks: DataFrame, windows: DataFrame, k: int, same: bool, id_shift: int) -> DataFrame:
    """(block, w, vec_id, score, rank): the first k rows of each window (block, w, a, low, top), by score from the top, then by id."""
    long = lambda n: F.lit(n).cast("bigint")
    width = F.coalesce(F.length(F.bin(F.try_subtract("top", "low"))), F.lit(64)).cast("bigint")
    start = {"need": long(k), "phase": long(0), "shift": F.greatest(width - DIGIT_BITS, long(0)), "prefix_shift": long(64), "prefix": long(0), "cut": F.col("low"), "id_cut": long(int(_LONG.max))}
    state = materialize(windows.withColumns(start), "windows")
    along = Window.partitionBy("block", "w").orderBy("bucket")
    while not state.filter("phase < 2").isEmpty():
        # Chunks have counted already; one exchange by window serves the sum, the running sum and the join.
        found = _over_pairs(chunks, blocks, state, same, None, ["bucket", "n"]).repartition("block", "w")
        counted = found.groupBy("block", "w", "bucket").agg(F.sum("n").alias("n"))
        kth = counted.withColumn("through", F.sum("n").over(along)).join(state.filter("phase < 2").select("block", "w", "need"), ["block", "w"])
        kth = kth.filter("through >= need AND through - n < need").select("block", "w", "bucket", "n", (F.col("through") - F.col("n")).alias("above"))
        state = materialize(_refined(state.join(kth, ["block", "w"], "left"), id_shift), "windows")
    found = _over_pairs(chunks, blocks, state, same, k, ["vec_id", "score"])
    order = Window.partitionBy("block", "w").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _refined(met: DataFrame, id_shift: int) -> DataFrame:
    """The windows after a pass: done where all rows up to the bucket have a place, else narrowed to the bucket."""
    col, found, by_id = F.col, F.col("bucket").isNotNull(), F.col("phase") == 1
    open_ = (col("phase") < 2) & found
    left = col("need") - col("above")
    # Bitwise, so that no sum leaves a long's range.
    last = F.call_function("shiftleft", col("bucket"), col("shift").cast("int")).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), col("shift").cast("int")) - 1)
    full = left == col("n")
    whole = open_ & (full | (by_id & (col("shift") == 0)))
    to_ids = open_ & ~whole & ~by_id & (col("shift") == 0)
    shift = F.greatest(col("shift") - DIGIT_BITS, F.lit(0).cast("bigint"))
    long = lambda n: F.lit(n).cast("bigint")
    new = {
        # A window with no kth row has fewer than it has places: all of it is let through.
        "phase": F.when(~found | whole, long(2)).when(to_ids, long(1)).otherwise(col("phase")),
        "need": F.when(open_ & ~whole, left).otherwise(col("need")),
        "cut": F.when(open_ & ~by_id & (whole | to_ids), F.greatest(F.bitwise_not(last), col("low"))).otherwise(col("cut")),
        "id_cut": F.when(open_ & by_id & whole, last).otherwise(col("id_cut")),
        "prefix_shift": F.when(to_ids, long(64)).when(open_ & ~whole, col("shift")).otherwise(col("prefix_shift")),
        "prefix": F.when(open_ & ~whole, col("bucket")).otherwise(col("prefix")),
        "shift": F.when(to_ids, long(id_shift)).when(open_ & ~whole, shift).otherwise(col("shift")),
    }
    return met.withColumns(new).drop("bucket", "n", "above")


def mine(rows: DataFrame, is_anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 5, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among `rows`.

    A component x counts as floor(scale * x), a score is the integer inner product, and higher
    scores come first, then smaller ids.  An anchor's positives are its first rows of the same
    label and another id; a positive's negatives are the first rows of other labels whose score
    is between 80 and 100 % of the positive's.  An anchor with fewer has those it has, and a
    positive with a score under 0 has none.

    Rows with a null id, label or vector, or a null or non-finite component take no part.  A
    shorter vector ends in zeros; an integer or a score beyond a long's range is its end.
    Repeated rows each take a place.  Other columns, whatever their names, are not looked at;
    an empty table gives an empty result.
    """
    kept = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("vector"), is_anchor.alias("anchor")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    chunks = materialize(_matrices(kept.drop("anchor"), scale, CHUNK_ROWS), "chunks")
    chosen = kept.filter("anchor").drop("anchor")
    n, least, most = kept.agg(F.count_if("anchor"), F.min("vec_id"), F.max("vec_id")).first()
    grouped = chosen.repartition(max(1, -(-n // BLOCK_ANCHORS)))
    blocks = materialize(_matrices(grouped, scale, BLOCK_ANCHORS).withColumn("block", F.monotonically_increasing_id()), "blocks")
    id_shift = _bits(least, most) if least is not None else 0

    @tidy
    def all_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, data = _read({f"a_{k}": v for k, v in row.items()}, "a")
                reach = [sum(map(abs, q)) * row["reach"] for q in data.tolist()]
                at = np.arange(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"])), pa.array(at), pa.array(at), pa.array([max(-b, _LONG.min) for b in reach], pa.int64()), pa.array([min(b, _LONG.max) for b in reach], pa.int64()), pa.array(ids)], ["block", "w", "a", "low", "top", "anchor_id"])

    # No score is further from zero than the anchor's sum of sizes times the largest size of all.
    reach = F.greatest(F.abs(F.max(F.array_max(F.col("vector")))), F.abs(F.min(F.array_min(F.col("vector")))))
    finite = kept.select(F.transform("vector", lambda x: F.when(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), x.cast("double"))).alias("vector"))
    largest = finite.agg(reach).first()[0] or 0.0
    size = int(scale * largest) + 1 if scale * largest < 2.0**62 else int(_LONG.max)
    spans = materialize(blocks.withColumn("reach", F.lit(size).cast("bigint")).mapInArrow(all_windows, "block bigint, w bigint, a bigint, low bigint, top bigint, anchor_id bigint"), "spans")
    near = _first(chunks, blocks, spans.drop("anchor_id"), positives, True, id_shift)
    near = materialize(near.join(spans.select("block", "w", "a", "anchor_id"), ["block", "w"]), "positives")
    wanted = near.filter("score >= 0").select("block", (F.col("w") * positives + F.col("rank") - 1).alias("w"), "a", F.expr("score - score div 5").alias("low"), F.col("score").alias("top"), "anchor_id", F.col("vec_id").alias("positive_id"))
    wanted = materialize(wanted, "wanted")
    far = _first(chunks, blocks, wanted.drop("anchor_id", "positive_id"), negatives, False, id_shift)
    return far.join(wanted.select("block", "w", "anchor_id", "positive_id", F.col("top").alias("positive_score")), ["block", "w"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
