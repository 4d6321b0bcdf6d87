"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe
from quarry.llm.queries import RANKS

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS, *bpe.splitting(PATTERN))


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(codec, library, texts):
    ids, bounds = codec.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]
    assert codec.decode(ids, bounds) == [t.encode() for t in texts]


CASES = [
    "", " ", "\n", "a", "it's  'sx  's   \n\n b \t c  d ", "-" * 3000, "a" * 5000, "abcdefghij" * 300, "x﷐  y", "世界你好" * 300,
    "՘ ՘a 's\U00010d40's", "a \n ", "\x1c\x1d a\x85b　 c", "<|endoftext|>", "é́", "\U0001f600" * 90, "\x00\x01", "1²٣ 4",
]


def test_given_texts(codec, library):
    same(codec, library, CASES)
    same(codec, library, [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'séa-՘\U00010d40﷐　"), st.characters(codec="utf-8")), max_size=80), max_size=20))
def test_any_texts(codec, library, texts):
    same(codec, library, texts)


def test_both_recursions_agree(codec, library):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdest-"), int(n))) for n in rng.integers(2, 300, 60)]
    for sql in (bpe._LEFTMOST, bpe._ALL_PLACES):
        for names, ids, lengths in codec._contract(words, sql):
            ends = np.cumsum(lengths)
            for name, end, n in zip(names, ends, lengths, strict=True):
                assert ids[end - n : end].tolist() == [-1] * n or ids[end - n : end].tolist() == library._encode_single_piece(name)


def test_memory_that_fills_up(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    for k in range(6):
        same(codec, library, [f"word{i}xyz common text" for i in range(k * 5, k * 5 + 12)])


ROWS = [(3, "b é c"), (1, None), (1, None), (None, "x y"), (2, ""), (3, "b é c"), (4, "long " * 40_000)]


def test_operators(spark, library):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in ROWS], "doc_id bigint, text string, ids int, value string")
    encoded = bpe.encode(docs, RANKS, PATTERN)
    expected = sorted((i if i is not None else -1, library.encode_ordinary(t or "")) for i, t in ROWS)
    found = encoded.collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(r.ids, "<u4").tolist()) for r in found) == expected
    assert all(r.n_tokens == len(r.ids) // 4 for r in found)
    back = bpe.decode(encoded, RANKS, PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((str(i), (t or "").encode()) for i, t in ROWS)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    told = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, RANKS, PATTERN).collect())
    assert told == sorted((str(r.doc_id), r.n_tokens, sha(bytes(r.ids)), sha((dict(ROWS)[r.doc_id] or "").encode())) for r in found)
    assert bpe.round_trip(docs.limit(0), RANKS, PATTERN).collect() == []
    nothing = spark.createDataFrame([(7, None)], "doc_id bigint, ids binary")
    assert [bytes(r.decoded) for r in bpe.decode(nothing, RANKS, PATTERN).collect()] == [b""]


def test_unknown_id(codec):
    with pytest.raises(ValueError):
        codec.decode(np.array([50_300], np.uint32), np.array([0, 1]))
