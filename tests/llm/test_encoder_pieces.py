"""Batches without odd characters against the tokenizers library, and no Python for each word once its pieces are known."""

import cProfile
import pstats
import random

import pyarrow as pa

from quarry.llm import tokens
from quarry.llm.queries import TOKENIZER

_PLAIN = [chr(c) for c in (*range(9, 14), *range(32, 127), *range(0xA1, 0x130), *range(0x131, 0x180))]
_USUAL = ["'s", "'T", "'re", "'ll", "''s", "!'ve", "don't", " ", "\n", "ABC", "x1y", "½", "Né", "...", "\x0b"]


def test_plain_texts_agree_with_the_library():
    encoder = tokens.Encoder(TOKENIZER)
    rng = random.Random(8)
    texts = ["".join(rng.choice(_USUAL if rng.random() < 0.6 else _PLAIN) for _ in range(rng.randint(0, 50))) for _ in range(4000)] + ["", " ", "\n\n"]
    for odd in ([], ["a\x1cb's İX’s"]):
        for at in range(0, len(texts), 50):
            part = texts[at : at + 50] + odd
            got = [x.tolist() for x in tokens.encoded(pa.array([None, *part])[1:], encoder, 1)]
            assert got == [[*e.ids, 1] for e in encoder.tokenizer.encode_batch(part, add_special_tokens=False)]


def test_known_words_cost_no_python_each():
    encoder = tokens.Encoder(TOKENIZER)
    texts = pa.array([" ".join(f"Word{i}x{k}," for i in range(2000)) for k in range(10)])
    first = [x.tolist() for x in tokens.encoded(texts, encoder, 1)]
    profile = cProfile.Profile()
    again = profile.runcall(lambda: list(tokens.encoded(texts, encoder, 1)))
    assert [x.tolist() for x in again] == first
    assert pstats.Stats(profile).total_calls < 2000
