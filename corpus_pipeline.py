"""Corpus pipeline: language, near copies, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, langid, packing, pii, simhash
from quarry.llm.queries import TOKENIZER, pii_key
from quarry.storage import materialize


#: Texts that go to a Python worker at once, unless the session says; Spark's 10,000 are some 35 MB of texts, held several times over.
ARROW_ROWS = 2000
_ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Small batches for the stages that work in Python; a session's own setting stays."""
    if spark.conf.get(_ARROW_SETTING) == "10000":
        spark.conf.set(_ARROW_SETTING, str(ARROW_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; the others go."""
    bounded_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    bounded_batches(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, their length counted anew."""
    bounded_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(docs, items).withColumn("n_chars", F.length("text").cast("bigint"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, their length counted anew."""
    done = "__done"
    while done in docs.columns:
        done += "_"
    told = docs.withColumn(done, pii.pseudonymise(F.col("text"), pii_key(spark)))
    return told.withColumns({"text": F.col(f"{done}.text"), "n_chars": F.length(f"{done}.text").cast("bigint")}).drop(done)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' tokens as pieces of sequences of at most 2048."""
    bounded_batches(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: SQL has neither the compressors nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
