"""The pipeline's near-copy stage against brute force at a similarity of 0.8."""

import numpy as np
import pytest

from quarry.llm import copies, simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(x, y):
    return len(x & y) / len(x | y)


def edited(rng, words, share):
    return [f"new{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("limit", [copies.BUCKET_ROWS, 8])
def test_keep_one_against_brute_force(spark, monkeypatch, limit):
    """Pairs around the threshold, most of all short ones, and one crowd: no link missed and none too many."""
    monkeypatch.setattr(copies.links, "__defaults__", (copies.THRESHOLD, limit))
    rng = np.random.default_rng(7)
    texts = []
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(20_000, size=rng.integers(40, 250))]
        texts += [words, edited(rng, words, (0.005, 0.015, 0.02, 0.03)[k % 4])]
    crowd = [f"c{x}" for x in rng.integers(20_000, size=150)]
    texts += [edited(rng, crowd, 0.012) for _ in range(60)]
    texts = [" ".join(t) for t in texts]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] & sets[j] and similarity(sets[i], sets[j]) >= 0.8]
    for i, j in near:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    assert len(near) > 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect())
    assert kept == [i for i in range(len(texts)) if find(i) == i]


def natural(rng, n):
    """Words by a law of frequency as texts have it."""
    return [f"w{int(x)}" for x in rng.zipf(1.3, size=n) % 30_000]


def passage(rng, words, share, replace):
    size = max(1, int(len(words) * share))
    at = int(rng.integers(0, len(words) - size * replace + 1))
    return words[:at] + [f"p{x}" for x in rng.integers(1 << 40, size=size)] + words[at + size * replace :]


def test_recall_by_kind_of_edit(spark):
    """Scattered words, one inserted passage and one replaced passage: in each band of similarity at least 0.95 of the pairs link."""
    rng = np.random.default_rng(11)
    kinds = {
        "scattered": lambda w: edited(rng, w, rng.uniform(0.001, 0.024)),
        "inserted": lambda w: passage(rng, w, rng.uniform(0.01, 0.26), 0),
        "replaced": lambda w: passage(rng, w, rng.uniform(0.01, 0.12), 1),
    }
    texts, told = [], []
    for kind, edit in kinds.items():
        for _ in range(330):
            words = natural(rng, int(rng.integers(80, 1500)))
            pair = [" ".join(t) for t in (words, edit(words))]
            told.append((kind, similarity(*map(shingles, pair))))
            texts += pair
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()}
    assert not [i for i in range(0, len(texts), 2) if i not in kept]
    for kind in kinds:
        for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
            band = [2 * k + 1 not in kept for k, (name, s) in enumerate(told) if name == kind and low <= s < high]
            assert len(band) >= 20 and np.mean(band) >= 0.95, (kind, low, len(band), np.mean(band))
    assert not [k for k, (_, s) in enumerate(told) if s < 0.8 and 2 * k + 1 not in kept]


def test_segments():
    words = [str(i).encode() for i in range(100)]
    assert len(copies.segments(words)) == 2 and copies.segments(words[:15]) == [] and len(copies.segments(words[:64])) == 4
    longer = words[:50] + [b"x"] * 25 + words[50:]
    assert set(copies.segments(words)) & set(copies.segments(longer))
    assert set(copies.segments(words)) & set(copies.segments([b"x"] * 25 + words)) and copies.segments([]) == []


def test_estimates():
    rng = np.random.default_rng(3)
    for n in (5, 200, 5000):
        pool = np.unique(rng.integers(1 << 32, size=2 * n, dtype=np.uint32))
        x, y = (np.sort(rng.permutation(pool)[: int(1.5 * n)]) for _ in range(2))
        both = len(np.intersect1d(x, y))
        told = copies.estimated(*(np.array(copies.least_hashes(s)).view(np.uint8) for s in (x, y)))
        assert abs(told - both / (len(x) + len(y) - both)) < 0.15
    assert copies.estimated(np.zeros(8, np.uint8), np.zeros(8, np.uint8)) == 0
