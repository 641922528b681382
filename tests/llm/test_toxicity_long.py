"""Features of long training texts are those of the whole text, in bounded memory; scores are held against a plain linear model."""

import random
import tracemalloc

import numpy as np
import pytest

from tallywright.llm import common, toxicity


def plain_features(text):
    """Hashed character n-grams of the folded text, position by position."""
    data, _ = toxicity.padded([text])
    out = set()
    for k, n in enumerate(toxicity.SIZES):
        for i in range(len(data) - n + 1):
            h = sum(int(common.BYTE_VALUE[b]) * int(common.WORD_MIX[j]) for j, b in enumerate(data[i : i + n])) % 2**64
            out.add((h >> (64 - toxicity.BITS)) + (k << toxicity.BITS))
    return sorted(out)


@pytest.mark.parametrize("piece", [5, 7, 64, None])
def test_features_of_pieces(monkeypatch, piece):
    if piece:
        monkeypatch.setattr(toxicity, "PIECE", piece)
    rnd = random.Random(1)
    for text in [b"", b"a", b"!!", "You are BAD, é \n\n ok".encode(), "".join(rnd.choice("abc  É!") for _ in range(400)).encode()]:
        assert toxicity.distinct(text).tolist() == plain_features(text)


def test_scores_against_a_plain_sum():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["foul", "vile", "calm", "kind", "word", "tree"][3 * (i % 2) : 3 * (i % 2) + 4]) for _ in range(30)).encode() for i in range(80)]
    model = toxicity.fit(texts, np.array([1 - i % 2 for i in range(80)]))
    for t, s in zip([*texts[:6], b"", b"???"], model.score([*texts[:6], b"", b"???"]), strict=True):
        z = model.bias + sum(float(model.weights[f]) for f in plain_features(t))
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-6
    assert (model.score(texts[::2]) > 0.5).all() and (model.score(texts[1::2]) < 0.5).all()


def test_memory_of_one_long_text():
    """16 MB of text: some bytes for each byte of it, not some hundred."""
    text = np.random.default_rng(3).integers(97, 123, 16 << 20, dtype=np.uint8).tobytes()
    tracemalloc.start()
    toxicity.distinct(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text)
