"""A group of texts that are all alike just under the threshold gives no row for each pair of them, at any step."""

import numpy as np

from quarry.llm import copies, simhash


def wanted(texts):
    """The least text of each group, by brute force."""
    split = [t.split() for t in texts]
    sets = [{hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)} for w in split]
    least = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(x & y)
            if both >= 0.8 * (len(x) + len(y) - both) and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = [low if k == high else k for k in least]
    return sorted(set(least))


def test_no_rows_for_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(1 << 40, size=1200)]
    texts = []
    for k in range(300):
        words = list(base)
        for at in rng.permutation(200)[:16] * 6 + rng.integers(6):
            words[at] = f"t{k}w{at}"
        texts.append(" ".join(words))
    texts.append(texts[0] + " and two")
    written, tables = {}, copies.PRINTS * 15 + 4

    def counted(df, label, write=copies.materialize):
        out = write(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(copies, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect())
    assert kept == wanted(texts)
    assert max(written.values()) <= len(texts) * tables
    assert max(v for k, v in written.items() if k not in ("copies-shared", "copies-labelled", "copies-met")) < 300 * 299 / 8
