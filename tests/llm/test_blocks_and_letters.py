"""Decontamination in many blocks, letters of all scripts, ties and repeated ids of the language model."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontam, langid

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("at_once", [1, 8])
def test_many_blocks_find_what_one_finds(spark, monkeypatch, at_once):
    monkeypatch.setattr(decontam, "BLOCKS_AT_ONCE", at_once)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"__spans": F.lit("x"), "__items": F.lit(1)})
    long = spark.createDataFrame([(9001, None), (9002, ""), (9003, "a b " * 40_000)], "doc_id bigint, text string")
    docs = docs.unionByName(long, allowMissingColumns=True)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    n = items.count()
    items = items.filter(F.col("item_id") % max(1, n // 10) == 0)
    one, many = (
        {r["id"]: (r["n_words"], [tuple(s) for s in r["spans"]], sorted(r["items"])) for r in decontam.hit_spans(docs, items, block_words=b).collect()}
        for b in (10**9, 60)
    )
    assert one == many and any(spans for _, spans, _ in one.values())
    whole, parted = (sorted((r["doc_id"], r["text"] or "") for r in decontam.decontaminate(docs, items, block_words=b).collect()) for b in (10**9, 60))
    assert whole == parted and decontam.decontaminate(docs, items).columns == docs.columns


def test_only_letters_count():
    assert [langid.letters(t) for t in (None, "", "²³ ① ½ 12 __", "́")] == [b""] * 4
    assert langid.letters("कि बात!").decode() == "कि बात" and langid.letters("Ab, c1d").decode() == "ab c d"


def test_ties_go_to_the_first_name_and_are_rejected():
    same = b"the very same words in both of the dictionaries " * 4
    one = langid.Model({"b": same, "a": same}, langid.Settings()).classifier()
    name, score, margin, rejected = one("the very same words")
    assert (name, margin, rejected) == ("a", 0, True) and score == 0.5


def test_repeated_ids_and_many_languages(spark):
    rows = [(1, f"text number {i} of one id", "xx") for i in range(50)] + [(7, "another text here", "yy")] * 3 + [(None, "no id", "zz")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert set(model.dictionaries) <= {"xx", "yy"} and all(len(d) < 100 for d in model.dictionaries.values())
    with pytest.raises(ValueError, match="max_languages"):
        langid.fit(docs, langid.Settings(max_languages=1))
