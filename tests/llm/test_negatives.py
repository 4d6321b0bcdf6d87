"""Hard negatives against a plain search."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from quarry.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<double>, ids string, windows int"


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def plain(rows, every):
    cut = lambda v: max(-(2**63), min(2**63 - 1, v))
    kept = []
    for vec, label, vector in rows:
        if vec is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec, label, [cut(math.floor(256 * x)) if abs(x) < 1e300 else (2**63 - 1 if x > 0 else -(2**63)) for x in vector]))
    out = []
    for a, label, q in kept:
        if a % every:
            continue
        scored = [(-cut(sum(x * y for x, y in zip(q, r, strict=False))), v, other) for v, other, r in kept]
        near = sorted(s[:2] for s in scored if s[2] == label and s[1] != a)[:5]
        for top, positive in near:
            far = sorted(s[:2] for s in scored if s[2] != label and 80 * -top <= 100 * -s[0] <= 100 * -top)[:5]
            out += [(a, positive, k + 1, v, -top, -s) for k, (s, v) in enumerate(far)]
    return sorted(out)


def check(spark, rows, every=5):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = negatives.mine(table.repartition(3), F.col("vec_id") % every == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, every)


def vectors(seed, n, spread):
    rng = random.Random(seed)
    return [(i * 7 - 30, rng.randint(0, 2), [rng.choice([0.9, 0.5, 0.7 + rng.random() * spread, -0.2]) for _ in range(6)]) for i in range(n)]


@pytest.mark.parametrize("digit", [12, 2])
def test_equals_plain(spark, monkeypatch, digit):
    """Narrow digits take many passes; one vector in a third of the rows makes ties that the ids decide."""
    monkeypatch.setattr(negatives, "DIGIT_BITS", digit)
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 16)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 8)
    check(spark, vectors(digit, 120, 0.3) + [(1000 + i, i % 2, [0.9] * 6) for i in range(60)])


def test_edges(spark):
    check(spark, [])
    check(spark, [(5, 1, [1.0])])
    odd = [
        (None, 1, [1.0, 1.0]), (0, None, [1.0, 1.0]), (5, 1, None), (10, 1, [1.0, None]), (15, 1, [1.0, float("nan")]), (20, 1, [float("inf"), 1.0]),
        (25, 1, [1.0, 1.0]), (30, 2, [1.0, 1.0]), (31, 2, [1.0]), (32, 1, []), (33, 1, [1.0, 0.9]), (33, 1, [1.0, 0.9]), (34, 2, [0.9, 0.9]), (34, 2, [0.9, 0.9]),
    ]
    check(spark, odd)
    far = 2**62
    check(spark, [(5, 1, [1e30, 2.0]), (6, 1, [1e16, 1.0]), (7, 2, [9e15, 1.0]), (8, 2, [1e300, -1.0]), (far, 2, [1e16, 1.0]), (-far * 2, 1, [1e16, 0.5]), (far * 2 - 1, 2, [1e16, 1.0])])
