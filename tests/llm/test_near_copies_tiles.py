"""Rows of a bucket are dealt out a bounded number of times, however many they are, and every two of them meet."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import copies, simhash


@pytest.mark.parametrize(("n", "size", "most"), [(8, 10, 1), (9, 10, 3), (600, 10, 16), (600, 2_000_000, 36)])
def test_every_two_rows_meet_once(spark, n, size, most):
    rows = spark.createDataFrame([(5, k, n, n * size) for k in range(n)], "key bigint, node bigint, n bigint, bytes bigint")
    tiles = {}
    for r in copies.tiles(rows, 8).collect():
        tiles.setdefault((r["lo"], r["hi"]), []).append((r["own"], r["node"]))
    assert sum(map(len, tiles.values())) == most * n
    met = [{x[1], y[1]} for (lo, hi), held in tiles.items() for x, y in combinations(held, 2) if lo == hi or x[0] != y[0]]
    assert len(met) == n * (n - 1) / 2 == len(set(map(frozenset, met)))


def test_a_crowd_is_not_dealt_by_its_square(spark, monkeypatch):
    """120 texts around the threshold in common buckets and blocks of two: a row is copied 16 times at most, and what whole buckets link is linked."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(1 << 40, size=600)]
    texts = []
    for k in range(120):
        words = list(base)
        for at in rng.permutation(100)[: 7 + k % 3] * 6 + rng.integers(6):
            words[at] = f"t{k}w{at}"
        texts.append(" ".join(words))
    docs, dealt = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), []

    def counted(self, run, schema, *more, to=type(docs).mapInArrow):
        if "lo" in self.columns:
            rows = self.select("key", F.explode("rows.node").alias("node")) if "rows" in self.columns else self
            dealt.append(rows.groupBy("key", "node").count().agg(F.max("count")).first()[0])
        return to(self, run, schema, *more)

    whole = sorted(r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect())
    assert 1 < len(whole) < len(texts)
    monkeypatch.setattr(copies.links, "__defaults__", (copies.THRESHOLD, 4))
    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()) == whole
    assert max(dealt) == 16, dealt
