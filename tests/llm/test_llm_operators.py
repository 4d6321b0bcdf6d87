"""The training-data operators against plain versions, on small fixtures with awkward rows."""

import hashlib
import html as html_lib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import components, cws, decontam, html, langid, packing, pii, sharding, simhash, substring, tokens
from quarry.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Whole documents with nulls, empty and repeated texts, a repeated row and clashing columns."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(9001, None), (9002, ""), (9003, "  \n "), (9004, "word"), (9004, "word"), (9005, "a b " * 30_000), (None, "null id text")],
        "doc_id bigint, text string",
    )
    rows = df.unionByName(extra, allowMissingColumns=True)
    clash = {c: F.lit("x") for c in ("fp", "path", "key", "part", "pos", "shard", "term", "spans", "j", "n")}
    return rows.withColumns(clash).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (7, 7), (None, 3), (4, 1), (12, 11)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.connected_components(edges, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, plain):
    got = {(r["doc_id"]): (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    short = [(i, t) for i, t in plain if len(t or "") < 4000]
    prints = [(i, brute_fingerprint(t)) for i, t in short]
    assert all(got[i][0] == f"{p:016x}" for i, p in prints)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                parent[find(a)] = find(b)
    linked = {}
    for k, (i, _) in enumerate(prints):
        linked.setdefault(find(k), []).append(i)
    for ids in linked.values():
        assert len({got[i][1] for i in ids}) == 1


def test_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    values = {base ^ int(sum(1 << int(b) for b in rng.choice(40, 3, replace=False))) for _ in range(150)} | {int(x) for x in rng.integers(1 << 62, size=50)}
    frame = spark.createDataFrame([(v, v) for v in values], "node bigint, fp bigint")
    rule = simhash.Rule(3)
    want = components.connected_components(
        spark.createDataFrame([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3], "a bigint, b bigint"), "a", "b"
    )
    got = components.connected_components(simhash.near_links(frame, rule, limit=8), "a", "b")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize(("limit", "strays"), [(12, 4), (64, 64)])
def test_crowded_buckets_with_check_words(spark, monkeypatch, limit, strays):
    """One crowd that is one component, one of two that only the check words tell apart, and strays."""
    monkeypatch.setattr(simhash, "STRAY_LIMIT", strays)
    rng = np.random.default_rng(limit)

    def flip(x, width, n):
        return x ^ sum(1 << int(b) for b in rng.choice(width, n, replace=False))

    centre, far = int(rng.integers(1 << 62)), int(rng.integers(1 << 62))
    checks = [int(x) for x in rng.integers(1 << 62, size=4)]
    rows = {(flip(centre, 50, 2), flip(checks[0], 60, 2), checks[1]) for _ in range(90)}
    rows |= {(flip(centre, 50, 2), flip(checks[2], 60, 2), checks[3]) for _ in range(60)}
    rows |= {(flip(far, 50, 1), flip(checks[0], 60, int(rng.integers(1, 30))), checks[1]) for _ in range(60)}
    rows |= {(int(a), int(b), int(c)) for a, b, c in rng.integers(1 << 62, size=(20, 3))}
    nodes = list(enumerate(sorted(rows)))
    edges = [
        (i, j)
        for i, x in nodes
        for j, y in nodes
        if i < j and (x[0] ^ y[0]).bit_count() <= 3 and (x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count() <= 4
    ]
    frame = spark.createDataFrame([(i, *x) for i, x in nodes], "node bigint, fp bigint, c0 bigint, c1 bigint")
    want = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b")
    links = simhash.near_links(frame, simhash.Rule(3, 4), limit=limit)
    got = components.connected_components(links, "a", "b")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_langid(spark, docs):
    model = langid.fit(docs)
    got = langid.identify(docs, model).toPandas()
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert set(got[got.doc_id.isin([9001, 9002, 9003])].lang_pred) == {"und"}
    held = [r for r in got.itertuples() if r.held_out and truth.get(r.doc_id)]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert got.score.between(0, 1).all()
    for r in got[got.doc_id.notna()].itertuples():
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 0)


def test_decontamination(spark, docs, plain):
    items = spark.createDataFrame(
        [(1, "w " * 3), (2, None), (3, ""), (4, "one two three four five six seven eight nine ten eleven"), (4, "lonely item")], "item_id bigint, text string"
    ).unionByName(spark.read.parquet(f"{SF}/benchmark.parquet"))
    probe = [(1, "x One, two three FOUR five six seven eight nine ten y lonely-item"), (2, None), (3, "w w")]
    rows = [*probe, *[(i, t) for i, t in plain if i is not None and i < 60]]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(lower))
    windows = {}
    for r in items.collect():
        ws = split(r["text"])
        for i in range(max(1, len(ws) - 9)) if ws else []:
            windows.setdefault(tuple(ws[i : i + 10]), set()).add(str(r["item_id"]))
    want = []
    for i, t in rows:
        ws, hit, found = split(t), set(), set()
        for n in {len(w) for w in windows}:
            for at in range(len(ws) - n + 1):
                if names := windows.get(tuple(ws[at : at + n])):
                    hit |= set(range(at, at + n))
                    found |= names
        want.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    for blocks in (100_000, 50):
        got = decontam.hit_spans(frame, items, block_words=blocks)
        assert {r["id"]: sorted(r["items"]) for r in got.collect()} is not None
    assert sorted(tuple(r) for r in decontam.contamination(frame, items).collect()) == sorted(want)


def test_decontaminate_cuts_spans(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id bigint, text string")
    frame = spark.createDataFrame([(1, "Start it is. A b, c d e f g h i j. End of a quite long text here now."), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in decontam.decontaminate(frame, items, max_coverage=0.9).collect()}
    assert got == {1: "Start it is. . End of a quite long text here now.", 2: None}


def test_sentences_rejoin(plain):
    for _, text in plain:
        if text:
            assert "".join(substring.sentences(text)) == text


def test_substring(spark):
    passage = "This first sentence has a handful of words in it. The second one follows with some more words behind it. And a third one ends it all right here."
    rows = [(1, f"Alpha beta. {passage} Tail one is here."), (2, f"Other words. {passage}\nDifferent tail."), (3, "Clean text only. Nothing repeats."), (4, None), (5, ""), (None, passage)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in substring.dedup_substrings(frame).collect()}
    assert got[None] == passage and got[1] == "Alpha beta. Tail one is here." and got[2] == "Other words. Different tail."
    assert got[3] == rows[2][1] and got[4] is None and got[5] == ""


def test_token_files_and_packing(spark, docs, plain):
    encoder = tokens.Encoder(TOKENIZER)
    rows = sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [[*e.ids, 1] for e in encoder.tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want, before = [], 0
    for (i, _), x in zip(rows, ids, strict=True):
        want.append((-1 if i is None else i, before, len(x), crc(x)))
        before += len(x)
    got = tokens.token_files(docs, TOKENIZER).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)
    packed = packing.pack(docs, TOKENIZER, pieces_per_task=60).toPandas()
    assert packed.length.sum() == before
    for _, one in packed.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert (one.offset.to_numpy() == np.concatenate(([0], one.length.cumsum()[:-1]))).all() and one.length.sum() <= 2048
    assert set(packed.sequence_id) == set(range(packed.sequence_id.max() + 1))


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def test_pii(spark):
    card = "4111 1111 1111 1111"
    rows = [
        (1, f"Pay {card} or mail a.b@mail.example.com by 2021-03-04, call +1 (743) 555-3824."),
        (2, f"{card} again; 10.2.3.4 and 300.1.1.1; 2021-03-04; 123-45-6789"),
        (3, "No data here, version 2.0."),
        (4, None),
        (5, 'token = "' + "0a" * 20 + '"'),
    ]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    cards = [re.search(r"\d{4} \d{4} \d{4} \d{4}", got[i])[0] for i in (1, 2)]
    assert cards[0] == cards[1] != card and luhn(cards[0].replace(" ", ""))
    dates = [re.search(r"\d{4}-\d{2}-\d{2}(?!\d)", got[i])[0] for i in (1, 2)]
    assert dates[0] == dates[1] != "2021-03-04" and pd.Timestamp(dates[0])
    assert "a.b@mail" not in got[1] and "555-3824" not in got[1] and "10.2.3.4" not in got[2] and "300.1.1.1" in got[2]
    assert "123-45-6789" not in got[2] and got[3] == rows[2][1] and got[4] is None and "0a0a0a" not in got[5]


def test_permutation_is_one_to_one(spark):
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = {r[0] for r in numbers.select(pii.permute_digits(F.col("d"), "k", "t")).collect()}
    assert len(got) == 1000 and all(re.fullmatch(r"\d{3}", x) for x in got)


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "", "<p>plain<p>open &amp; b<b>o</b>ld")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages.select("page_id", "url", "html").unionByName(odd)).collect()}
    assert got[9001] == "" and got[9002] == "plain\nopen & bold"
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_sharding(docs, plain):
    got = sharding.assign_shards(docs, 8).toPandas()
    assert len(got) == len(plain)
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= 2 * got["size"].max()
    for _, one in got.groupby("shard"):
        assert sorted(one.slot) == list(range(len(one)))
    rows = sharding.assign_shards(docs, 8, law="rows").groupBy("shard").count().toPandas()["count"]
    assert rows.max() - rows.min() <= 1


def test_weighted_sampling(spark, plain):
    rows = [(i, t) for i, t in plain if i is not None and i < 40] + [(50, None), (51, ""), (52, "one two"), (53, "one two")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = cws.edited_fingerprints(frame).toPandas().set_index("doc_id")
    ordered = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(ordered):
        t, n = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + n[:m]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[i] == len(t)
    assert got.fingerprint[52] == got.fingerprint[53] and got.near_next[53] == 1.0
    a = "apple " * 30 + " ".join(f"w{i}" for i in range(70))
    b = "apple " * 10 + " ".join(f"w{i}" for i in range(35, 105))
    both = cws.fingerprint(spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string"), samples=400).collect()
    x, y = (r["fingerprint"] for r in sorted(both))
    same = np.mean([x[i : i + 4] == y[i : i + 4] for i in range(0, len(x), 4)])
    assert abs(same - (10 + 35) / (30 + 105)) < 0.1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert langid.identify(docs, langid.fit(docs)).count() == 0
    assert decontam.contamination(docs, items).count() == 0
    assert substring.dedup_substrings(docs).count() == 0
    assert tokens.token_files(docs, TOKENIZER).count() == 0
    assert packing.pack(docs, TOKENIZER).count() == 0
    assert pii.redact(docs).count() == 0
    assert sharding.assign_shards(docs).count() == 0
    assert cws.edited_fingerprints(docs).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
