"""The registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, cws, decontam, html, langid, negatives, packing, pii, sharding, simhash, substring, tokens, tries

#: The tokenizer of the two token operators.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The ranks of byte-level BPE.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pii_key(spark: SparkSession) -> str:
    """The session's key; the registered queries run over invented documents, so they have one of their own."""
    return spark.conf.get(pii.KEY_SETTING, "") or "invented documents"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, radius=3)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(_table(spark, sf_dir, "documents"), TOKENIZER)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(_table(spark, sf_dir, "documents"), pii_key(spark))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), 40, "bytes").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(_table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_langid,
        op3_decontamination,
        op4_substring_dedup,
        op5_token_files,
        op6_pii,
        op7_html,
        op8_sharding,
        op9_weighted_sampling,
        op10_packing,
        op11_prefix_trie,
        op12_hard_negatives,
        op13_byte_bpe,
    )
}

_TRIE = r"""WITH RECURSIVE turns AS (
 SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS digest,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
crc(conv_id, name, i, c) AS (
 SELECT conv_id, CAST(conv_id AS VARCHAR), 0, 4294967295::BIGINT FROM sizes
 UNION ALL
 SELECT conv_id, name, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
 FROM (SELECT conv_id, name, i, CASE WHEN i % 8 = 0 THEN xor(c, ord(substr(name, i // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM crc WHERE i < 8 * len(name))),
plan AS (SELECT s.conv_id, s.conv_id - s.conv_id % 20 AS base, xor(c, 4294967295) % 4 AS h FROM sizes s JOIN crc USING (conv_id) WHERE i = 8 * len(name)),
built AS (SELECT p.conv_id, t.pos AS part, 0 AS own, t.digest, t.words FROM plan p JOIN turns t ON t.conv_id = p.base AND t.pos <= p.h
 UNION ALL SELECT p.conv_id, t.pos, 1, t.digest, t.words FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.pos > p.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, part) AS depth, digest, words FROM built),
paths AS (SELECT conv_id, depth, string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS key, words FROM placed
 UNION ALL SELECT conv_id, 0, '', 0 FROM sizes),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
 coalesce(string_agg(CASE WHEN depth = length THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM paths JOIN lengths USING (conv_id) GROUP BY key, depth),
links AS (SELECT c.key, p.key AS above FROM nodes c JOIN paths p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1),
kids AS (SELECT above AS key, count(*) AS n FROM links GROUP BY above),
below AS (SELECT p.key, count(CASE WHEN k.n IS NULL THEN 1 END) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved
 FROM nodes c LEFT JOIN kids k USING (key) JOIN paths p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY p.key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves,
 CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b USING (key) LEFT JOIN kids k USING (key) LEFT JOIN links l USING (key) LEFT JOIN nodes a ON a.key = l.above"""

_NEGATIVES = """WITH v AS (
 SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
 FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
 vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""

ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": _TRIE, "op12_hard_negatives": _NEGATIVES}
