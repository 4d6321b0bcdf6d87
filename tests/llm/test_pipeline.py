"""Stages of the corpus pipeline on a small fixture."""

import corpus_pipeline
from quarry.llm import simhash


def test_one_of_each_group_stays(spark):
    base = " ".join(f"word{i} filler{i * 7 % 101}" for i in range(200))
    near = base.replace("word50 ", "changed ")
    other = " ".join(f"quite{i} different{i * 3 % 89}" for i in range(200))
    rows = [(3, base), (1, base), (2, near), (4, other), (4, other), (5, None), (6, ""), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5]


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language"](spark, docs, "/root/testdata/sf0.001")
    clean = stages["decontamination"](spark, told, "/root/testdata/sf0.001")
    final = stages["pii"](spark, clean, "/root/testdata/sf0.001")
    assert told.columns == clean.columns == final.columns == docs.columns
    assert told.count() >= 0.97 * docs.count() and final.count() >= 0.97 * told.count()
