"""The encoder against the tokenizers library on odd texts, and bit packing at every width."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import tokens
from quarry.llm.queries import TOKENIZER

_ODD = [*range(0x250), *range(0x300, 0x320), 0x130, 0x131, 0x17F, 0x200B, 0x2019, 0x2028, 0x212A, 0x3000, 0x4E2D, 0xFB01, 0x1100, 0x1161, 0x1E9E, 0x1F600]
_USUAL = ["'s", "'t", "'re", " ", "\n", "don't", "I'LL", "x'", "é", "ABC", "12", "½", "  ", "\x1c", "\x85", "\xa0", "née"]


def test_odd_texts_agree_with_the_library():
    encoder = tokens.encoder_for(TOKENIZER)
    rng = random.Random(3)
    common = _USUAL + [chr(c) for c in range(32, 127)]
    texts = [
        "".join(chr(rng.choice(_ODD)) if rng.random() < 0.3 else rng.choice(common) for _ in range(rng.randint(0, 40))) for _ in range(3000)
    ]
    texts += ["", "a <|endoftext|> b", "word " * 50_000]
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        got = [x.tolist() for x in tokens.encoded(pa.array(part), encoder, 1)]
        assert got == [[*e.ids, 1] for e in encoder.tokenizer.encode_batch(part, add_special_tokens=False)]


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    encoder = tokens.Encoder(TOKENIZER)
    part = ["one two three four", "five six, seven eight nine ten!", "one six eleven"]
    got = [x.tolist() for _ in range(2) for x in tokens.encoded(pa.array(part), encoder, 1)]
    assert got == 2 * [[*e.ids, 1] for e in encoder.tokenizer.encode_batch(part, add_special_tokens=False)]


@pytest.mark.parametrize("width", range(1, 33))
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(1 << width, size=1001, dtype=np.uint64).astype("<u4")
    packed = tokens.pack_bits(ids, width)
    assert len(packed) == -(-1001 * width // 8) and (tokens.unpack_bits(packed, width, 1001) == ids).all()


def test_random_access_at_odd_widths(tmp_path):
    rng = np.random.default_rng(1)
    docs = [(i if i % 7 else None, rng.integers(1 << 13, size=n).astype("<u4")) for i, n in enumerate([0, 5, 700, 1, 64, 0, 129, 33])]
    path = tmp_path / "x.qtok"
    with pa.OSFile(str(path), "wb") as sink:
        writer = tokens.Writer(sink, 13, block_ids=64)
        for one in docs:
            writer.add(*one)
        writer.close()
    with pa.OSFile(str(path), "rb") as source:
        reader = tokens.Reader(source)
        assert reader.doc_ids == [i for i, _ in docs]
        assert all((reader.document(i) == x).all() for i, (_, x) in enumerate(docs))
        assert all((x == y).all() for (_, x), (_, _, y) in zip(docs, reader.documents(), strict=True))
