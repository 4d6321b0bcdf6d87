"""Buckets with one pivot are one group: a text of a crowd is few rows, and every pair of a bucket is told in one group."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from quarry.llm import copies


def crowd(n):
    """Texts of 600 words, of which 2 to 8 are each one's own."""
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(1 << 40, size=600)]
    for k in range(n):
        words = list(base)
        for at in rng.permutation(600)[: 2 + k % 7]:
            words[at] = f"t{k}w{at}"
        yield " ".join(words)


def test_rows_of_a_crowd(spark):
    """Few of a text's 94 buckets have a pivot of their own, and twice the texts give no four times the rows."""

    def rows_of(n):
        docs = spark.createDataFrame(list(enumerate(crowd(n))), "doc_id bigint, text string")
        return copies.grouped(copies.sketches(docs, "doc_id", "text")).count()

    few, many = rows_of(150), rows_of(300)
    assert many < 300 * 30 and many <= 2.5 * few, (few, many)


def test_every_pair_of_a_bucket_is_told_in_one_group(spark):
    rng = np.random.default_rng(3)
    prints = rng.integers(1 << 63, size=(1, copies.PRINTS), dtype=np.uint64).repeat(40, axis=0)
    for row in prints:
        for at in rng.integers(copies.PRINTS * 64, size=30):
            row[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    ends = [[k % 3] if k < 20 else [] for k in range(40)]
    nodes = spark.createDataFrame([(k, p.view(np.int64).tolist(), e) for k, (p, e) in enumerate(zip(prints, ends, strict=True))], "node bigint, fps array<bigint>, ends array<bigint>")
    groups = defaultdict(dict)
    for r in copies.grouped(nodes).collect():
        groups[r["key"]][r["node"]] = np.array([r["early"], r["late"]]).view(np.uint64)
    told = Counter()
    for held in groups.values():
        for x, y in combinations(sorted(held), 2):
            told[x, y] += int(copies.told_here(prints[[y]], prints[x], (held[x] & held[y])[None])[0])
    for x, y in combinations(range(40), 2):
        by_prints = ((prints[x] ^ prints[y])[:, None] & copies._MASKS == 0).any()
        alike = bool(set(ends[x]) & set(ends[y]))
        assert told[x, y] == (by_prints or alike), (x, y)
    assert 0 < sum(told.values()) < 40 * 39 / 2
