"""SimHash components, packed pieces and the pipeline's ends against plain versions, over whole small tables."""

import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import packing, simhash, tokens
from quarry.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"


def test_components_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "A b c"), (9004, "a  B c"), (9005, "x " * 50_000)], "doc_id bigint, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.unionByName(odd).collect()]
    prints = []
    for _, text in rows:
        ws = (text or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))] if ws else []
        values, counts = np.unique(np.array(hs, np.uint64), return_counts=True)
        bits = ((values[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
        sums = (bits * counts[:, None]).sum(axis=0)
        prints.append(sum(1 << b for b in range(64) if 2 * int(sums[b]) > len(hs)))
    least = [i for i, _ in rows]
    changed = True
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in near:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs.unionByName(odd)).collect()}
    assert got == {i: (f"{p:016x}", m) for (i, _), p, m in zip(rows, prints, least, strict=True)}


def test_pieces_hold_their_documents_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, "long " * 30_000)], "doc_id bigint, text string"), allowMissingColumns=True)
    rows = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    encoder = tokens.encoder_for(TOKENIZER).tokenizer
    ids = {i: [*encoder.encode(t, add_special_tokens=False).ids, 1] for i, t in rows.items()}
    found = packing.pack(docs, TOKENIZER).collect()
    for r in found:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, all_ids in ids.items():
        at = 0
        for r in sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(all_ids)
    total, sequences = sum(map(len, ids.values())), len({r["sequence_id"] for r in found})
    assert total > 0.95 * 2048 * (sequences - 1)


def test_run_and_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__done", F.lit("kept"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0 and empty.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    done = dict(corpus_pipeline.STAGES)["pii"](spark, docs, SF)
    assert {r[0] for r in done.select("__done").distinct().collect()} == {"kept"}
    whole = corpus_pipeline.run(spark, SF)
    kept = {r["doc_id"] for r in whole.select("doc_id").distinct().collect()}
    assert kept <= {r["doc_id"] for r in docs.select("doc_id").collect()} and len(kept) > 0.5 * docs.count()
