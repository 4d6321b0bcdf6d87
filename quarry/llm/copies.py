"""Near copies by the exact Jaccard similarity of five-word shingle sets, proposed by SimHash.

Every text has six independent 64-bit SimHash fingerprints of its words (all words, weighted
by 1 + ln of how often they occur).  The covering masks of `simhash` put two texts into a
common bucket in some table wherever one of the six pairs of fingerprints differs in three
bits or fewer; the six together reach what one alone would miss at a similarity of 0.8.  One
inserted or replaced passage moves more word weight than scattered words do at the same
similarity, but it leaves one half of the text as it was, so texts that begin or end alike
over a quarter to a half of their length meet as well.  The fingerprints only propose: a
link is confirmed by the exact similarity of the two sets of shingle hashes.

A text of a crowd stands with much the same texts in most of its buckets, so the buckets
that have the same pivot, their least node, are one group: a text is a row of a group once, with the tables
in which they meet.  Each text is first checked against the pivot that it meets in most tables.
Groups that then still hold several components are searched once, for a
forest of the closest texts, which is checked, and for the rows that have any other pair to
check; in what groups are open after the forest these rows meet with their sets.  Both
leave out pairs whose similarity, estimated from the least shingle hashes of 256 ranges, is
far under the threshold.  Pairs, whose number grows with the square of a crowd of texts that
are all alike just under the threshold, are never rows: texts meet in tiles of a group, where
only links are given.  A group is one tile while it is small; a larger one is dealt out in a
bounded number of blocks, every two of which are a tile, so a row is copied a bounded number
of times.  The comparisons in the tiles still grow with the square of such a crowd.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.simhash import BITS, _handed, _long_array, covering_masks, shingles
from quarry.llm.workers import tidy
from quarry.storage import materialize

WIDTH = 5
THRESHOLD = 0.8
PRINTS, RADIUS = 6, 3
#: Differing bits of all six fingerprints above which a pair is not checked.  Sets at 0.8 lie at an angle
#: of 0.476 at most, so 58 of the 384 bits differ, with a standard error of 7: this is four of them above.
MOST_BITS = 86
#: Ranges of shingle hashes of which a text keeps the least one's byte.
BINS = 256
#: How far under the threshold an estimate may lie: at 0.8 its standard error is 0.025, so this is four of them.
SLACK = 0.1
#: Words that two texts must begin or end with to meet, and how much longer than the other one text of a link can be.
LEAST_SEGMENT, LONGER = 8, 1.25
#: Differing bits up to which a pair may stand in the forest that is checked before all others.
CLOSE_BITS = 45
#: Rows of a group compared in one task; of larger ones every two blocks meet.
BUCKET_ROWS = 2048
#: Rows of a group whose sets of shingles meet in one task.
SET_ROWS = 512
#: Blocks of a group, and so copies of a row, unless two of them would hold more than TILE_BYTES.
MOST_BLOCKS = 16
TILE_BYTES = 64 << 20
#: Bytes of a text's fingerprints and least hashes.
PRINT_BYTES = PRINTS * BITS // 8 + BINS
#: Words or shingles worked on at once, so one endless text stays within bounded memory.
CHUNK = 1 << 13

_MASKS = np.array(covering_masks((1 << BITS) - 1, RADIUS), np.uint64)
#: Number of the table of equal ends, after all of the fingerprints'.
ENDS = PRINTS * len(_MASKS)
_MIX = np.arange(1, PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def _bits(words: list[bytes]) -> np.ndarray:
    """A row of PRINTS * 64 random bits for each word."""
    seed = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    z = seed[:, :1] * _MIX + seed[:, 1:]
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unpackbits((z ^ (z >> np.uint64(32))).view(np.uint8), axis=1)


def sketch(words: list[bytes]) -> list[int]:
    """The fingerprints of a text with words: a bit is set if the words that set it weigh over half."""
    counts = Counter(words)
    names, total = list(counts), np.zeros(PRINTS * BITS, np.float64)
    weights = 1 + np.log(np.fromiter(counts.values(), np.float32, len(names)))
    for at in range(0, len(names), CHUNK):
        total += weights[at : at + CHUNK] @ _bits(names[at : at + CHUNK]).astype(np.float32)
    return np.packbits(total * 2 > weights.sum(dtype=np.float64)).view(">i8").tolist()


def least_hashes(members: np.ndarray) -> list[int]:
    """A byte from 1 to 255 of the least of the sorted shingle hashes in each of BINS ranges, 0 in an empty one, eight to an integer."""
    ranges, first = np.unique(members >> np.uint32(24), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[ranges] = members[first] % np.uint32(255) + 1
    return out.view("<i8").tolist()


def segments(words: list[bytes]) -> list[int]:
    """Hashes of the text's first and last words, over the largest power of two that is at most half of them.

    A text that a shorter one of a smaller power may link to is cut to that as well.
    """
    n = len(words)
    sizes = {1 << (max(1, int(m / 2)).bit_length() - 1) for m in (n, n / LONGER)}
    parts = [(size, end) for size in sizes if LEAST_SEGMENT <= size for end in (words[:size], words[-size:])]
    return [xxhash.xxh3_64_intdigest(b" ".join(end), seed=2 * size + (k % 2)) - (1 << 63) for k, (size, end) in enumerate(parts)]


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, fps, hashes, ends) of every row; equal word sequences have one node, a text without words has null `fps`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, hashes, ends = [], [], [], []
            for t in batch.column(1).cast(pa.binary()):
                text = t.as_py() or b""
                words = text.lower().split()
                nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63))
                prints.append(sketch(words) if words else None)
                hashes.append(least_hashes(shingle_set(text)) if words else None)
                ends.append(segments(words))
            arrays = [pa.array(nodes, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (prints, hashes, ends))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "node", "fps", "hashes", "ends"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(tidy(run), f"id {kind}, node bigint, fps array<bigint>, hashes array<bigint>, ends array<bigint>")


def shingle_set(text: bytes) -> np.ndarray:
    """The different shingles of the text as sorted 32-bit hashes.

    Two texts of n shingles have n * n / 2^32 chance agreements: 1e-5 at 200, 0.1 at 20,000.
    """
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, chunk), np.uint64, len(chunk)) for chunk in shingles(text, WIDTH)]
    return np.unique(np.concatenate(parts or [np.zeros(0, np.uint64)]).astype(np.uint32))


def _sets(texts: DataFrame) -> DataFrame:
    """(node, members) of `texts(node, text)`, one row for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"").tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "members"])

    return texts.select("node", "text").mapInArrow(tidy(run), "node bigint, members binary").groupBy("node").agg(F.first("members").alias("members"))


def alike(x: bytes, y: bytes, threshold: float) -> bool:
    """Whether two sets of shingle hashes have at least this exact Jaccard similarity."""
    x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= threshold * (len(x) + len(y) - both) - 1e-9


def _sets_of(ends: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, members) of the nodes of `ends(node)`; only their texts are hashed."""
    wanted = materialize(nodes.join(_handed(materialize(ends.distinct(), "copies-ends")), "node", "left_semi").select("node", F.col("least").alias("id")), "copies-wanted")
    return _sets(texts.join(_handed(wanted), "id"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least this exact Jaccard similarity; only their texts are hashed."""
    sets = _sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), nodes, texts)
    joined = _handed(pairs).join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(x.as_py(), y.as_py(), threshold) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(joined.select("a", "b", "x", "y").mapInArrow(tidy(run), "a bigint, b bigint"), "copies-links")


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32)


def estimated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The similarity of sets by their least hashes."""
    either = (x != 0) | (y != 0)
    return ((x == y) & either).sum(axis=-1) / np.maximum(either.sum(axis=-1), 1)


def first_met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first table in which fingerprints meet, that of equal ends if there is none."""
    meet = ((x ^ y)[..., None] & _MASKS == 0).reshape(len(x), ENDS)
    return np.where(meet.any(axis=1), meet.argmax(axis=1), ENDS)


def told_here(x: np.ndarray, y: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Whether the first table in which fingerprints meet is one of this group; `met` are the bits of the tables that both have in it."""
    table = first_met(x, y)
    return met[np.arange(len(met)), table >> 6] >> (table & 63).astype(np.uint64) & np.uint64(1) > 0


def candidates(label: np.ndarray, prints: np.ndarray, hashes: np.ndarray, half: int | None, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, rows behind i) of one tile within MOST_BITS and of an estimate of at least `least` whose labels differ; labels may change meanwhile.

    Of a tile of two blocks, the first of `half` rows, only pairs of both are told.
    """
    if len(label) <= 128 and not (_differ(prints[:, None], prints[None]) <= MOST_BITS)[label[:, None] != label[None]].any():
        return
    for i in range(len(label) - 1 if half is None else half):
        rest = max(i + 1, half or 0)
        at = np.flatnonzero((label[rest:] != label[i]) & (_differ(prints[rest:], prints[i]) <= MOST_BITS)) + rest
        yield i, at[estimated(hashes[at], hashes[i]) >= least]


def tile_search(
    node: np.ndarray, label: np.ndarray, prints: np.ndarray, hashes: np.ndarray, met: np.ndarray, half: int | None, least: float
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A forest (a, b), a < b, of the candidates of one tile within CLOSE_BITS, and the rows with a candidate that is told here.

    A pair joins its labels in the forest, so there are fewer pairs than labels.
    """
    joined, mark, out = label.copy(), np.zeros(len(label), bool), []
    for i, at in candidates(label, prints, hashes, half, least):
        close = at[joined[at] != joined[i]]
        close = close[_differ(prints[close], prints[i]) <= CLOSE_BITS]
        if len(close):
            labels, first = np.unique(joined[close], return_index=True)
            joined[np.isin(joined, labels)] = joined[i]
            out += [(min(node[i], node[j]), max(node[i], node[j])) for j in close[first]]
        if mark[i]:
            at = at[~mark[at]]
        at = at[told_here(prints[at], prints[i], met[at] & met[i])]
        mark[at] = True
        mark[i] |= len(at) > 0
    return out, mark


def tile_links(
    node: np.ndarray, label: np.ndarray, prints: np.ndarray, hashes: np.ndarray, met: np.ndarray, half: int | None, members: list[bytes], least: float, threshold: float
) -> list[tuple[int, int]]:
    """Links (a, b) of one tile: candidates that are told here and whose sets are alike; a link joins its labels."""
    label, out = label.copy(), []
    for i, at in candidates(label, prints, hashes, half, least):
        for j in at[told_here(prints[at], prints[i], met[at] & met[i])]:
            if label[j] != label[i] and alike(members[i], members[j], threshold):
                label[label == label[j]] = label[i]
                out.append((node[i], node[j]))
    return out


def _open(rows: DataFrame, groups: DataFrame) -> DataFrame | None:
    """(key, node, early, late, label, n) of the `rows(key, node, early, late)` of every key whose n rows are of several of `groups`; null if none is."""
    label = F.coalesce("component", "node").alias("label")
    labelled = materialize(rows.join(groups, "node", "left").select("key", "node", "early", "late", label), "copies-labelled")
    split = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    split = materialize(split.select("key", "n"), "copies-split")
    return None if split.isEmpty() else labelled.join(_handed(split), "key")


def tiles(rows: DataFrame, limit: int) -> DataFrame:
    """`rows(key, node, n, bytes, ...)` dealt to the tiles (key, lo, hi) of their group, which has n rows of so many bytes; `own` is a row's block.

    Every two rows of a group meet in a tile: one of both blocks, or of the block that both are in.
    """
    blocks = F.greatest(F.least(F.ceil(F.col("n") * 2 / limit), F.lit(MOST_BLOCKS)), F.ceil(F.col("bytes") * 2 / TILE_BYTES)).cast("int")
    small, none = (F.col("n") <= limit) & (F.col("bytes") <= TILE_BYTES), F.lit(0)
    whole = rows.filter(small).withColumns({"own": none, "lo": none, "hi": none})
    cut = rows.filter(~small).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(none, blocks - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    return whole.unionByName(cut.drop("other")).drop("n", "bytes")


def _by_tile(rows: DataFrame, work: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """`work` on every tile of `rows`, which are read as a stream of tiles; it gets the tile as a table, (node, label, prints, hashes, met) and where its second block begins."""
    spark = rows.sparkSession
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "own", "node")

    def of(tile: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(tile).combine_chunks().to_batches()[0]
        node, label, own = (whole.column(c).to_numpy() for c in ("node", "label", "own"))
        prints, hashes = (whole.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("fps", "hashes"))
        lo, hi = (whole.column(c)[0].as_py() for c in ("lo", "hi"))
        met = np.stack([whole.column(c).to_numpy() for c in ("early", "late")], axis=1).view(np.uint64)
        arrays = (node, label, prints.view(np.uint64).reshape(-1, PRINTS), np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, BINS), met)
        return work(whole, *arrays, None if lo == hi else int((own == lo).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, last = [], None
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi")], axis=1)
            starts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist()] if batch.num_rows else []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                name = tuple(names[lo])
                if tile and name != last:
                    yield of(tile)
                    tile = []
                tile, last = [*tile, batch.slice(lo, hi - lo)], name
        if tile:
            yield of(tile)

    return dealt.mapInArrow(tidy(run), schema)


def _searched(rows: DataFrame, nodes: DataFrame, limit: int, least: float) -> DataFrame:
    """`tile_search` of the open `rows`: (a, b) with a null key for the forest, (key, a, early, late) with a null b for the rows with other candidates."""

    def work(tile: pa.RecordBatch, node: np.ndarray, label: np.ndarray, prints: np.ndarray, hashes: np.ndarray, met: np.ndarray, half: int | None) -> pa.RecordBatch:
        forest, mark = tile_search(node, label, prints, hashes, met, half, least)
        pairs, found = np.array(forest, np.int64).reshape(-1, 2), tile.filter(pa.array(mark))
        none, names = pa.nulls(len(pairs), pa.int64()), ["key", "a", "b", "early", "late"]
        left = [none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none]
        right = [found.column("key"), found.column("node"), pa.nulls(len(found), pa.int64()), found.column("early"), found.column("late")]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(left, right, strict=True)], names)

    dealt = tiles(rows.withColumn("bytes", F.col("n") * PRINT_BYTES).join(nodes.select("node", "fps", "hashes"), "node"), limit)
    # A row of a group with several tiles, or a pair of several groups, is told more than once.
    return _by_tile(dealt, work, "key bigint, a bigint, b bigint, early bigint, late bigint").distinct()


def _linked(rows: DataFrame, nodes: DataFrame, texts: DataFrame, limit: int, least: float, threshold: float) -> DataFrame:
    """`tile_links` of the open `rows` with their sets."""
    rows = materialize(rows, "copies-open")
    sets = _sets_of(rows.select("node"), nodes, texts).join(nodes.select("node", "fps", "hashes"), "node")
    sets = materialize(sets.withColumn("bytes", F.length("members")), "copies-sets")
    bytes_ = rows.join(sets.select("node", "bytes"), "node").groupBy("key").agg(F.sum(F.col("bytes") + PRINT_BYTES).alias("bytes"))
    sized = rows.join(_handed(materialize(bytes_, "copies-bytes")), "key")

    def work(tile: pa.RecordBatch, node: np.ndarray, label: np.ndarray, prints: np.ndarray, hashes: np.ndarray, met: np.ndarray, half: int | None) -> pa.RecordBatch:
        found = tile_links(node, label, prints, hashes, met, half, tile.column("members").to_pylist(), least, threshold)
        ends = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    dealt = tiles(sized.join(sets.drop("bytes"), "node"), limit)
    return _by_tile(dealt, work, "a bigint, b bigint").distinct()


def grouped(nodes: DataFrame) -> DataFrame:
    """(key, node, early, late) of the texts that share a bucket: `key` is the least node of a bucket, and a node is in a row with it once.

    `early` and `late` are the bits of the tables, 64 each, in which that is the least node of its bucket.
    """
    masks = covering_masks((1 << BITS) - 1, RADIUS)
    tables = F.explode(F.sequence(F.lit(0), F.lit(ENDS - 1))).alias("table")
    spread = nodes.filter("fps IS NOT NULL").select("node", "fps", tables)
    masked = F.get("fps", F.expr(f"cast(table div {len(masks)} as int)")).bitwiseAND(F.get(_long_array(masks), F.col("table") % len(masks)))
    # One exchange serves the buckets' sizes and their rows; a hot group's rows are spread over all tables.
    met = spread.select("node", "table", F.xxhash64("table", masked).alias("bucket"))
    alike = nodes.filter("fps IS NOT NULL").select("node", F.explode("ends").alias("end")).select("node", F.lit(ENDS).alias("table"), F.xxhash64(F.lit(ENDS), "end").alias("bucket"))
    dealt = met.unionByName(alike).repartition("bucket")
    least = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("key")).filter("n > 1")
    bits = [F.bit_or(F.expr(f"if(table div 64 = {k}, shiftleft(1L, table % 64), 0L)")).alias(name) for k, name in enumerate(("early", "late"))]
    return dealt.join(least, "bucket").groupBy("key", "node").agg(*bits)


def links(nodes: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, limit: int = BUCKET_ROWS) -> DataFrame:
    """(node, component) of the nodes of `nodes(node, least, fps, hashes, ends)` that have a near copy; component is the least of its group."""
    rows = materialize(grouped(nodes), "copies-shared")
    prints = _handed(nodes.select("node", "fps"))
    near = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d) <= MOST_BITS
    most = F.max_by("key", F.struct(F.bit_count("early") + F.bit_count("late"), "key")).alias("a")
    pairs = (
        rows.filter("node <> key").groupBy(F.col("node").alias("b")).agg(most)
        .join(prints.withColumnsRenamed({"node": "a", "fps": "x"}), "a")
        .join(prints.withColumnsRenamed({"node": "b", "fps": "y"}), "b")
        .filter(near).select("a", "b")
    )
    tested = materialize(pairs, "copies-tested")
    joined = connected_components(_confirmed(tested, nodes, texts, threshold), "a", "b")

    def more(found: DataFrame) -> DataFrame:
        # What is joined already goes on as one edge for each node, so new links meet finished stars.
        stars = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return connected_components(stars.unionByName(found), "a", "b")

    rows = _open(rows, joined)
    if rows is None:
        return joined
    met = materialize(_searched(rows, nodes, limit, threshold - SLACK), "copies-met")
    close = materialize(met.filter("key IS NULL").select("a", "b").join(tested, ["a", "b"], "left_anti"), "copies-close")
    if not close.isEmpty():
        joined = more(_confirmed(close, nodes, texts, threshold))
    # Labels only merge, so no row can have a candidate now that had none before.
    rows = _open(met.filter("b IS NULL").select("key", F.col("a").alias("node"), "early", "late"), joined)
    if rows is not None:
        joined = more(materialize(_linked(rows, nodes, texts, min(limit, SET_ROWS), threshold - SLACK, threshold), "copies-links"))
    return joined


def losers(prints: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id) of the rows of `prints(id, node, fps, hashes, ends)` that are not the least of their group."""
    nodes = materialize(
        prints.groupBy("node").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("fps", "hashes", "ends")], F.count(F.lit(1)).alias("rows")), "copies-nodes"
    )
    linked = materialize(links(nodes, texts, threshold).join(nodes.select("node", "least"), "node"), "copies-linked")
    best = linked.groupBy("component").agg(F.min("least").alias("keep"))
    near = linked.join(_handed(materialize(best, "copies-best")), "component").select("node", "keep")
    alone = nodes.filter("rows > 1").join(_handed(linked.select("node")), "node", "left_anti")
    keep = materialize(near.unionByName(alone.select("node", F.col("least").alias("keep"))), "copies-keep")
    return prints.join(_handed(keep), "node").filter("id <> keep").select("id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near copies, the one with the smallest id.

    Two texts link if the sets of their five-word shingles (lower-cased words at white space;
    a shorter text is one shingle) have a Jaccard similarity of at least `threshold`; a group is what links
    connect.  Texts without words are one group.  Of rows that share the smallest id one
    stays, the first by a hash of its text; null ids stay only where a group has no other.
    """
    me, doc = "__quarry_copy", F.col(id_col)
    tag = F.struct(doc.isNull().alias("none"), F.coalesce(doc.cast("bigint"), F.lit(0)).alias("doc"), F.xxhash64(text_col).alias("text"))
    tagged = docs.withColumn(me, tag)
    prints = materialize(sketches(tagged, me, text_col), "copies-prints")
    gone = _handed(materialize(losers(prints, tagged.select(F.col(me).alias("id"), F.col(text_col).alias("text")), threshold).distinct(), "copies-gone"))
    kept = tagged.join(gone.withColumnRenamed("id", me), me, "left_anti")
    twice = materialize(prints.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias(me)), "copies-twice")
    if not twice.isEmpty():  # equal ids and texts: one row of each, the others as they are
        again = _handed(twice)
        kept = kept.join(again, me, "left_anti").unionByName(kept.join(again, me, "left_semi").dropDuplicates([me]))
    return kept.select(*docs.columns)
