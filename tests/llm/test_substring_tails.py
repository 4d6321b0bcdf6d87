"""Repeated passages are removed to their last sentence, however short it is."""

import numpy as np

from quarry.llm import substring


def sentence(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(1 << 40, size=n)) + "."


def test_short_closing_sentences_go(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k, sizes in enumerate([(30, 30, 10, 10), (26, 26, 3, 2, 1), (8, 9, 40, 4), (12, 14), (13, 12, 24), (49, 49, 1)]):
        passage = " ".join(sentence(rng, n) for n in sizes)
        head, tail = sentence(rng, 20), sentence(rng, 20)
        rows += [(10 * k, passage), (10 * k + 1, f"{head} {passage} {tail}"), (10 * k + 2, passage)]
        want |= {10 * k: passage, 10 * k + 1: f"{head} {tail}", 10 * k + 2: ""}
    got = {r["doc_id"]: r["text"] for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_every_qualifying_passage_is_covered():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.integers(1, 30, size=rng.integers(2, 9))
        if sizes.sum() < substring.MIN_WORDS:
            continue
        parts = [sentence(rng, n) + " " for n in sizes]
        around = [sentence(rng, 5) + " "] + parts + [sentence(rng, 5) + " "]
        alone = {data for _, _, data in substring.runs(parts, substring.MIN_WORDS, substring.LONG_SENTENCE)}
        found = set()
        for first, n, data in substring.runs(around, substring.MIN_WORDS, substring.LONG_SENTENCE):
            if data in alone:
                found.update(range(first, first + n))
        assert found == set(range(1, len(parts) + 1))
