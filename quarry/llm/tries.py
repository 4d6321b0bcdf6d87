"""The prefix trie of conversations, as chains of nodes that one conversation owns.

A node is owned by its smallest member.  Along a conversation the depths it owns are its last
ones, so the first owned depth is found by binary search: one batched join a step, of all
conversations' middle depths, against the smallest conversation of each prefix digest.
A conversation's owned depths form a chain that hangs below another conversation's node, and
these chains are totalled from the bottom, a round for each level of chains.

Prefix digests are exclusive-or sums of 128 bits over (depth, MD5 of role and text), so a
long conversation is summed in blocks; texts themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.workers import tidy
from quarry.operators.positions import numbered
from quarry.storage import materialize

#: A fixed value: words are runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Depths of one conversation that are summed in one task, and bits of the ids that are joined in one.
BLOCK_DEPTHS, MEMBER_BITS = 1024, 12
NO_ENDS = hashlib.sha256().hexdigest()


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, position, digest, words) of every turn, positions from 1 by turn, nulls first, equal turns by digest.

    A null role or text is empty.  Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary")))).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    placed = numbered(rows, ["conv_id", "turn", "digest"], "place")
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("place") - F.col("first") + 1).alias("position"), "digest", "words")


def rebuilt(turns: DataFrame, group: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another one, as (conv_id, depth, digest, words) and (conv_id, length).

    Conversation c takes the first h turns of conversation c - c % group, h = crc32(c) % shared,
    and its own turns after its first h.
    """
    own = materialize(digests(turns), "turns")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", taken)
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    lengths = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    given = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = sizes.select("*", base).join(lengths, "base", "left").select("conv_id", "base", "h", given.alias("given"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
    plan = materialize(plan, "plan")
    opening = own.filter(F.col("position") < shared).withColumnRenamed("conv_id", "base")
    first = plan.join(opening, "base").filter("position <= given").select("conv_id", F.col("position").alias("depth"), "digest", "words")
    rest = own.join(plan, "conv_id").filter("position > h").select("conv_id", (F.col("position") - F.col("h") + F.col("given")).alias("depth"), "digest", "words")
    return first.unionByName(rest), plan.select("conv_id", (F.col("given") + F.col("own")).alias("length"))


def _running(rows: DataFrame, sums: dict[str, tuple[Callable, Column]], deepest: int, backwards: bool = False) -> DataFrame:
    """`rows` with running sums, each a (function, column), along a conversation's depths, block by block where some are deep."""
    depth, block = (F.col(c).desc() if backwards else F.col(c) for c in ("depth", "block"))
    inside = rows.withColumn("block", F.shiftright(F.col("depth"), BLOCK_DEPTHS.bit_length() - 1))
    along = Window.partitionBy("conv_id", "block").orderBy(depth)
    found = inside.withColumns({name: how(column).over(along) for name, (how, column) in sums.items()})
    if deepest < BLOCK_DEPTHS:
        return found.drop("block")
    totals = inside.groupBy("conv_id", "block").agg(*[how(column).alias(name) for name, (how, column) in sums.items()])
    earlier = Window.partitionBy("conv_id").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "block", *[F.coalesce(how(name).over(earlier), F.lit(0)).alias(f"__{name}") for name, (how, _) in sums.items()])
    added = {name: F.col(name).bitwiseXOR(F.col(f"__{name}")) if how is F.bit_xor else F.col(name) + F.col(f"__{name}") for name, (how, _) in sums.items()}
    return found.join(before, ["conv_id", "block"]).withColumns(added).drop("block", *[f"__{name}" for name in sums])


def prefixes(rows: DataFrame, deepest: int) -> DataFrame:
    """(conv_id, depth, x, y, words, through): the prefix's digest, the turn's words and all words up to it."""
    halves = {name: (F.bit_xor, F.xxhash64(F.lit(name), F.col("depth"), F.col("digest"))) for name in ("x", "y")}
    summed = _running(rows, halves | {"through": (F.sum, F.col("words"))}, deepest)
    return materialize(summed.select("conv_id", "depth", "x", "y", "words", "through"), "prefixes")


def first_owned(found: DataFrame, lengths: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, length, first): the first depth from 1 that each conversation owns, length + 1 where it owns none."""
    state = materialize(lengths.select("conv_id", "length", F.lit(1).cast("bigint").alias("low"), (F.col("length") + 1).alias("high")), "search")
    while not state.filter("low < high").isEmpty():
        middle = state.filter("low < high").withColumn("depth", F.expr("(low + high) div 2"))
        met = middle.join(found.select("conv_id", "depth", "x", "y"), ["conv_id", "depth"]).join(minima, ["depth", "x", "y"])
        owned = F.col("owner") == F.col("conv_id")
        moved = met.select("conv_id", "length", F.when(owned, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owned, F.col("depth")).otherwise(F.col("high")).alias("high"))
        state = materialize(moved.unionByName(state.filter("low = high")), "search")
    return state.select("conv_id", "length", F.col("low").alias("first"))


def _hung(searched: DataFrame, found: DataFrame, minima: DataFrame, root: int) -> DataFrame:
    """(conv_id, length, first, parent, at, before): where each chain hangs, and the words of the prefix there."""
    above = found.select("conv_id", (F.col("depth") + 1).alias("first"), "depth", "x", "y", F.col("through").alias("before"))
    below_root = searched.filter((F.col("first") == 1) & (F.col("conv_id") != root))
    others = searched.filter((F.col("first") > 1) & (F.col("conv_id") != root)).join(above, ["conv_id", "first"]).join(minima, ["depth", "x", "y"])
    zero = F.lit(0).cast("bigint")
    return materialize(
        others.select("conv_id", "length", "first", F.col("owner").alias("parent"), F.col("depth").alias("at"), "before")
        .unionByName(below_root.select("conv_id", "length", "first", F.lit(root).cast("bigint").alias("parent"), zero.alias("at"), zero.alias("before")))
        .unionByName(searched.filter(F.col("conv_id") == root).select("conv_id", "length", zero.alias("first"), F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("bigint").alias("at"), zero.alias("before"))),
        "chains",
    )


_EVENT = ("convs", "kids", "leaves", "weight", "saved")


def _events(rows: DataFrame) -> DataFrame:
    """What hangs below each node (parent, at), summed."""
    return rows.groupBy("parent", "at").agg(*[F.sum(c).alias(c) for c in _EVENT])


def totals(chains: DataFrame) -> DataFrame:
    """(parent, at, convs, kids, leaves, weight, saved): what all chains hand to the nodes they hang below.

    Chains that no open chain hangs below are totalled in a round; weight is the sum of
    conversations times the words of the prefix they hang below.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ended = chains.filter("first > length AND parent IS NOT NULL").select("parent", "at", one.alias("convs"), none.alias("kids"), none.alias("leaves"), F.col("before").alias("weight"), none.alias("saved"))
    given = materialize(_events(ended), "events")
    waiting = materialize(chains.filter("first <= length"), "waiting")
    while not waiting.isEmpty():
        above = waiting.select(F.col("parent").alias("conv_id")).distinct()
        ready = waiting.join(above, "conv_id", "left_anti")
        held = given.withColumnRenamed("parent", "conv_id").withColumnRenamed("at", "depth")
        sums = held.join(ready.select("conv_id", "length"), "conv_id").groupBy("conv_id").agg(
            *[F.sum(c).alias(c) for c in ("convs", "leaves", "weight", "saved")],
            F.sum(F.when(F.col("depth") == F.col("length"), F.col("kids")).otherwise(0)).alias("end_kids"),
        )
        n = {c: F.coalesce(c, none) for c in ("convs", "leaves", "weight", "saved", "end_kids")}
        size = n["convs"] + 1
        new = ready.filter("parent IS NOT NULL").join(sums, "conv_id", "left").select(
            "parent", "at", size.alias("convs"), one.alias("kids"),
            (n["leaves"] + F.when(n["end_kids"] == 0, 1).otherwise(0)).alias("leaves"),
            (size * F.col("before")).alias("weight"),
            (n["weight"] - n["convs"] * F.col("before") + n["saved"]).alias("saved"),
        )
        given = materialize(_events(given.unionByName(new)), "events")
        waiting = materialize(waiting.join(above, "conv_id", "left_semi"), "waiting")
    return given


def _ends(chains: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes at which conversations end.

    Ids are joined 2**MEMBER_BITS at most in a task, and a hash takes the joined parts in order
    as a stream: a node at which very many end is read by one task, as the hash asks, but never held.
    """
    owns = F.col("first") <= F.col("length")
    at = chains.select(F.when(owns, F.col("conv_id")).otherwise(F.col("parent")).alias("node"), F.col("length").alias("depth"), F.col("conv_id").alias("member"))
    parts = at.groupBy("node", "depth", F.shiftright("member", MEMBER_BITS).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("member")), ",").alias("ids"))
    ordered = parts.repartition("node", "depth").sortWithinPartitions("node", "depth", "part")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def told(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])

        for batch in batches:
            done = []
            for node, depth, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (node, depth) != now:
                    if now:
                        done.append((*now, held.hexdigest()))
                    now, held = (node, depth), hashlib.sha256()
                else:
                    held.update(b",")
                held.update(ids.encode())
            yield told(done)
        if now:
            yield told([(*now, held.hexdigest())])

    return ordered.mapInArrow(run, "conv_id bigint, depth bigint, ends_sha256 string")


def trie(turns: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """The nodes of the rebuilt conversations' prefix trie, a row each, with totals of their subtrees.

    `turns` has conv_id, turn, role and text.  Null turns come first and equal turns in the order
    of their digests; a null role or text is empty; repeated rows are turns of their own; rows
    without a conv_id and other columns, whatever their names, take no part.  Texts and
    conversations may be of any length.  Without a conversation there is no node, not even a root.
    """
    rows, lengths = rebuilt(turns, group, shared)
    lengths = materialize(lengths, "lengths")
    root, deepest = lengths.agg(F.min("conv_id"), F.coalesce(F.max("length"), F.lit(0))).first()
    found = prefixes(rows, deepest)
    minima = materialize(found.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("owner")), "minima")
    chains = _hung(first_owned(found, lengths, minima), found, minima, root if root is not None else 0)
    given = totals(chains).withColumnRenamed("parent", "conv_id").withColumnRenamed("at", "depth")
    owned = found.select("conv_id", "depth", "words", "through").join(chains.filter("first <= length"), "conv_id").filter("depth >= first")
    zero = F.lit(0).cast("bigint")
    top = chains.filter("parent IS NULL").withColumns({"depth": zero, "words": zero, "through": zero})
    nodes = owned.unionByName(top).join(given, ["conv_id", "depth"], "left").na.fill(0, list(_EVENT))
    end_kids = F.when(F.col("depth") == F.col("length"), F.col("kids")).otherwise(0)
    sums = {f"{c}_below": (F.sum, F.col(c)) for c in ("convs", "leaves", "weight", "saved")} | {"end_kids": (F.sum, end_kids)}
    below = _running(nodes, sums, deepest, backwards=True)
    deeper = F.col("depth") < F.col("length")
    nodes = below.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        (F.col("convs_below") + 1).alias("n_convs"),
        (F.col("kids") + deeper.cast("bigint")).alias("n_children"),
        (F.col("leaves_below") + F.when(F.col("end_kids") == 0, 1).otherwise(0)).alias("n_leaves"),
        (F.col("weight_below") + F.col("saved_below") - F.col("convs_below") * (F.col("through") - F.col("words"))).alias("saved_tokens"),
    )
    return nodes.join(_ends(chains), ["conv_id", "depth"], "left").na.fill(NO_ENDS, ["ends_sha256"])
