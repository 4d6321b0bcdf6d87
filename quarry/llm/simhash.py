"""SimHash near-duplicates found with covering locality-sensitive hashing.

A covering code assigns each of the 64 bit positions a non-zero vector of r+1 bits.  The
mask of a non-zero selector keeps the positions whose vector has odd inner product with
it.  The vectors of at most r differing positions span a proper subspace, so some selector
is orthogonal to them all: its mask drops every differing bit, and the pair shares a bucket
in that table.  There are no false negatives within the radius (Pagh, 2016).

Buckets are never expanded into pairs.  A bucket of bounded size is linked by a spanning
forest.  In a larger one each fingerprint is compared with one pivot, another in every
table, and only what then still lies in different components is searched further: a few
strays against the whole bucket, many by covering the bucket again over the bits its mask
left free.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.workers import tidy
from quarry.storage import materialize

BITS = 64
#: Fingerprints compared directly in one bucket; larger buckets are thinned by a pivot and covered again.
BUCKET_LIMIT = 4096
#: Strays of a large bucket that all its rows are compared with; more are covered again.
STRAY_LIMIT = 64
#: Shared buckets up to this many are handed to every task; more are joined by a shuffle.
BROADCAST_BUCKETS = 500_000
#: Shingles unpacked to bits at once, so one endless text stays within bounded memory.
CHUNK = 1 << 16


def shingles(text: bytes, width: int) -> Iterator[list[bytes]]:
    """The text's word shingles, repeats included, in chunks of bounded size.

    Lower-cases A-Z, splits on ASCII white space.  Fewer words than `width` make one shingle
    of the whole sequence; no word makes none.
    """
    words = text.lower().split()
    if words and len(words) <= width:
        yield [b" ".join(words)]
    elif words:
        joined = b" ".join(words)
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        ends, starts = (after[width - 1 :] - 1).tolist(), [0, *after[:-width].tolist()]
        for at in range(0, len(starts), CHUNK):
            yield [joined[a:b] for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)]


def majority(text: bytes, width: int, digest: Callable[[bytes, int], bytes], bits: int) -> list[int]:
    """A bit for each bit of the digests, set if over half of them set it, as signed 64-bit words."""
    total, n = np.zeros(bits, np.int64), 0
    for parts in shingles(text, width):
        data = np.frombuffer(b"".join(map(digest, parts, repeat(42))), np.uint8).reshape(-1, bits // 8)
        total += np.unpackbits(data, axis=1).sum(axis=0, dtype=np.int64)
        n += len(parts)
    return np.packbits(total * 2 > n).view(">i8").tolist() if n else [0] * (bits // BITS)


def fingerprint(text: bytes, width: int) -> int:
    """64-bit SimHash of XXH64 hashes with seed 42, as a signed integer; 0 if there is no word."""
    return majority(text, width, xxhash.xxh64_digest, BITS)[0]


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row of `docs`; a null text counts as empty and gets zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py() or b"", width) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "fp"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(tidy(run), f"id {kind}, fp bigint")


def covering_masks(free: int, radius: int) -> list[int]:
    """2^(radius+1)-1 masks over the set bits of `free` that cover every difference of `radius` bits."""
    n = (1 << (radius + 1)) - 1
    positions = [p for p in range(BITS) if free >> p & 1]
    return [
        sum(1 << p for i, p in enumerate(positions) if ((i % n + 1) & selector).bit_count() & 1)
        for selector in range(1, n + 1)
    ]


def _long_array(masks: list[int]) -> Column:
    """The masks as an array literal; a mask's top bit makes it negative."""
    signed = (m - (1 << BITS) if m >> (BITS - 1) else m for m in masks)
    return F.expr("array(" + ",".join(f"cast('{m}' as bigint)" for m in signed) + ")")


@dataclass(frozen=True)
class Level:
    """Masks of one covering; `masks[path]` belongs to table number `path`."""

    masks: list[int]
    fan: int

    @classmethod
    def first(cls, radius: int) -> Level:
        masks = covering_masks((1 << BITS) - 1, radius)
        return cls(masks, len(masks))

    def next(self, radius: int) -> Level:
        """Each table covered again over the bits that its mask leaves free."""
        masks = [m | s for m in self.masks for s in covering_masks(~m & ((1 << BITS) - 1), radius)]
        return Level(masks, (1 << (radius + 1)) - 1)


@dataclass(frozen=True)
class Rule:
    """Two fingerprints link at `radius` bits or fewer and, if they carry check bits, at `check` of those."""

    radius: int = 3
    check: int | None = None


def spanning_forest(rows: np.ndarray, rule: Rule) -> tuple[list[int], list[int]]:
    """Edges (by position) of a forest whose trees are the components of `rows` under `rule`.

    A row is a fingerprint and its check words, as unsigned 64-bit numbers.
    """
    left, right = [], []
    rest = np.arange(1, len(rows))
    queue = [0] if len(rows) else []
    while queue or len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        x = queue.pop()
        near = np.bitwise_count(rows[rest, 0] ^ rows[x, 0]) <= rule.radius
        if rule.check is not None and near.any():
            at = np.flatnonzero(near)
            near[at] = np.bitwise_count(rows[rest[at], 1:] ^ rows[x, 1:]).sum(axis=1) <= rule.check
        if near.any():
            found = rest[near].tolist()
            left += [x] * len(found)
            right += found
            queue += found
            rest = rest[~near]
    return left, right


def _link_buckets(buckets: DataFrame, rule: Rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            members, offsets = column.values, column.offsets.to_numpy()
            nodes = members.field(0).to_numpy()
            values = np.stack([members.field(i).to_numpy().view(np.uint64) for i in range(1, members.type.num_fields)], axis=1)
            a, b = [], []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                left, right = spanning_forest(values[lo:hi], rule)
                a += nodes[lo:hi][left].tolist()
                b += nodes[lo:hi][right].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.select("members").mapInArrow(tidy(run), "a bigint, b bigint")


def _near(a: list[Column], b: list[Column], rule: Rule) -> Column:
    """Two fingerprints, each with its check words, link under `rule`."""
    differ = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    linked = differ[0] <= rule.radius
    return linked if rule.check is None else linked & (sum(differ[1:], F.lit(0)) <= rule.check)


def _handed(table: DataFrame) -> DataFrame:
    """A table of one row per bucket, broadcast if a count finds it small."""
    return F.broadcast(table) if table.count() <= BROADCAST_BUCKETS else table


def _pivot_links(rows: DataFrame, columns: list[str], rule: Rule) -> DataFrame:
    """Edges from the rows of each bucket to its pivot, the row with the least hash of node and table."""
    pivot = F.min_by(F.struct(*columns), F.xxhash64("node", "path")).alias("pivot")
    pivots = materialize(rows.groupBy("path", "key").agg(pivot), "simhash-pivots")
    joined = rows.join(_handed(pivots), ["path", "key"])
    near = _near([F.col(c) for c in columns[1:]], [F.col(f"pivot.{c}") for c in columns[1:]], rule)
    return joined.filter(near).select(F.col("node").alias("a"), F.col("pivot.node").alias("b")).filter("a <> b").distinct()


def _split_buckets(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the `label` of their component, and (path, key, main, strays, n) of the buckets that hold several.

    `main` is the component with most rows in the bucket, `strays` counts the others' rows.
    """
    found = connected_components(links, "a", "b")
    labelled = materialize(
        rows.join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"),
        "simhash-labelled",
    )
    parts = labelled.groupBy("path", "key", "label").agg(F.count(F.lit(1)).alias("rows"))
    buckets = parts.groupBy("path", "key").agg(
        F.max_by("label", F.struct("rows", "label")).alias("main"),
        (F.sum("rows") - F.max("rows")).alias("strays"),
        F.sum("rows").alias("n"),
    )
    return labelled, materialize(buckets.filter("strays > 0"), "simhash-split")


def _stray_links(labelled: DataFrame, buckets: DataFrame, columns: list[str], rule: Rule) -> DataFrame:
    """Edges between the components that meet in `buckets`: every row is compared with the bucket's strays."""
    rows = labelled.join(_handed(buckets.select("path", "key", "main")), ["path", "key"])
    strays = rows.filter(F.col("label") != F.col("main")).groupBy("path", "key").agg(
        F.collect_list(F.struct(*columns[1:], "label")).alias("strays")
    )
    own = [F.col(c) for c in columns[1:]]
    linked = F.filter(
        "strays", lambda s: (s["label"] != F.col("label")) & _near(own, [s[c] for c in columns[1:]], rule)
    )
    others = F.array_distinct(F.transform(linked, lambda s: s["label"]))
    return rows.join(strays, ["path", "key"]).select(F.col("label").alias("a"), F.explode(others).alias("b")).distinct()


def near_links(distinct: DataFrame, rule: Rule, limit: int = BUCKET_LIMIT, levels: int = 2) -> DataFrame:
    """Edges (a, b) between nodes of `distinct(node, fp, check words ...)` that span its components.

    Every component of the graph under `rule` is connected by the result; links that a
    forest makes redundant are left out.  A bucket over `limit` whose rows the links found
    so far put into one component is done; one with at most `STRAY_LIMIT` rows outside its main
    component is finished by comparing those with all; others are covered again.  What is
    still open after the last level is dealt out in blocks, and every two blocks meet in a
    task of their own.
    """
    columns = distinct.columns
    members = F.collect_list(F.struct(*columns)).alias("members")
    level, rows, found = Level.first(rule.radius), distinct.withColumn("path", F.lit(0)), []

    def all_found() -> DataFrame:
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    for depth in range(levels):
        table = F.explode(F.sequence(F.col("path") * level.fan, F.col("path") * level.fan + level.fan - 1))
        keyed = rows.select(*columns, table.alias("path")).withColumn(
            "key", F.col("fp").bitwiseAND(F.get(_long_array(level.masks), F.col("path")))
        )
        sizes = materialize(
            keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets"
        )
        shared = _handed(sizes)
        small = keyed.join(shared.filter(F.col("n") <= limit), ["path", "key"])
        found.append(_link_buckets(small.groupBy("path", "key").agg(members), rule).distinct())
        large = sizes.filter(F.col("n") > limit)
        if large.isEmpty():
            break
        open_rows = materialize(keyed.join(_handed(large.select("path", "key")), ["path", "key"]), "simhash-large")
        found.append(_pivot_links(open_rows, columns, rule))
        found = [materialize(all_found(), "simhash-links")]
        labelled, split = _split_buckets(open_rows, found[0])
        few, many = split.filter(F.col("strays") <= STRAY_LIMIT), split.filter(F.col("strays") > STRAY_LIMIT)
        if not few.isEmpty():
            found.append(_stray_links(labelled, few, columns, rule))
        if many.isEmpty():
            break
        left = labelled.join(_handed(many), ["path", "key"])
        if depth + 1 < levels:
            rows, level = left.select(*columns, "path"), level.next(rule.radius)
            continue
        blocks = F.ceil(F.col("n") * 2 / limit).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks)
        dealt = left.select(
            *columns, "path", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
        ).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        found.append(_link_buckets(dealt.groupBy("path", "key", "lo", "hi").agg(members), rule).distinct())
    return all_found()


def components(prints: DataFrame, rule: Rule) -> DataFrame:
    """(fingerprint columns, component_id) for every different fingerprint of `prints(id, fp, ...)`."""
    names = prints.columns[1:]
    node = F.xxhash64(*names) if len(names) > 1 else F.col("fp")
    distinct = materialize(
        prints.groupBy(*names).agg(F.min("id").alias("least")).withColumn("node", node), "simhash-distinct"
    )
    links = connected_components(near_links(distinct.select("node", *names), rule), "a", "b")
    labelled = distinct.join(links, "node", "left").select(*names, "least", F.coalesce("component", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return labelled.join(least, "label").select(*names, "component_id")


def near_duplicates(
    docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Fingerprints at `radius` bits or fewer are linked; `component_id` is the smallest id
    reachable.  Null and empty texts have fingerprint zero and are linked like any other.
    Repeated ids keep one row each; null ids are kept and never chosen as `component_id`
    unless a component has no other.  Further columns are ignored, an empty table gives an
    empty result.
    """
    prints = materialize(fingerprints(docs, width, id_col, text_col), "simhash")
    return prints.join(components(prints, Rule(radius)), "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near copies, by exact similarity (see `copies.keep_one`)."""
    from quarry.llm import copies  # noqa: PLC0415 - it imports this module

    return copies.keep_one(docs, threshold, id_col, text_col)
