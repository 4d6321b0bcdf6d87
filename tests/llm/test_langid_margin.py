"""Texts in no learned language are rejected at every length, real held-out ones are not."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import langid

LETTERS = list("abcdefghijklmnopqrstuvwxyz")


def test_random_letters_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    one = model.classifier()
    rng = np.random.default_rng(11)

    def random_text(n):
        return " ".join("".join(rng.choice(LETTERS, rng.integers(2, 10))) for _ in range(n))

    for n, times in ((1, 50), (5, 50), (12, 50), (25, 50), (50, 50), (200, 50), (1000, 30), (5000, 3)):
        assert all(one(random_text(n))[3] for _ in range(times)), n
    held = docs.filter(langid.held_out(F.col("doc_id"))).filter(F.size(F.split("text", r"\s+")) >= 20)
    judged = [one(r["text"])[3] for r in held.select("text").collect()]
    assert len(judged) > 100 and sum(judged) <= 0.01 * len(judged)
