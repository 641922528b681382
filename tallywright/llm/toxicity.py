"""Operator 9, toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of bytes of the lower-cased text, with every run of non-letters as one boundary byte, present
or absent. Each is scaled by the log of the ratio of its smoothed document frequencies in toxic and other training texts;
a logistic regression is fitted on the scaled features. Of the hashed n-grams the FEATURES with the strongest evidence
are kept, so that the model is a fixed-size table.

Edge cases: an empty or null text is scored like any other: the intercept and the features of a single boundary; equal texts score
alike; without labels of both classes each text gets the class seen (0.5 is never reached without a toxic label).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, LOWER, PIECE, U64, WORD_MIX, buffers, fold, tidy
from .labelled import sample
from .quality import logistic

SIZES = (4, 5, 6)
BITS = 18
FEATURES = 12_000
THRESHOLD = 0.5
#: Bytes that aren't ASCII letters or parts of other UTF-8 letters count as a space.
PLAIN = LOWER.copy()
PLAIN[:128] = np.where(np.array([chr(c).isalpha() for c in range(128)]), LOWER[:128], 32)


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The hashed n-gram that starts at each byte."""
    size = max(len(data) - n + 1, 0)
    h = np.zeros(size, U64)
    value = BYTE_VALUE[data]
    for j in range(n):
        h += value[j : j + size] * WORD_MIX[j]
    return (h >> U64(64 - BITS)).astype(np.int32)


def present(data: np.ndarray, offs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs as two arrays, of features with a weight only. Feature: size index << BITS | hash.

    Goes through the bytes in pieces of bounded size that overlap by the longest n-gram less one."""
    keys = []
    lead = max(SIZES) - 1
    for at in range(0, max(len(data), 1), PIECE):
        piece = data[at : at + PIECE + lead]
        for k, n in enumerate(SIZES):
            h = grams(piece, n)[:PIECE]
            pos = np.flatnonzero(weights[k << BITS : (k + 1) << BITS][h])
            if not len(pos):
                continue
            doc = np.searchsorted(offs, pos + at, side="right") - 1
            inside = pos + at + n <= offs[doc + 1]
            keys.append(np.unique((doc[inside].astype(np.int64) << 32) | (h[pos[inside]].astype(np.int64) + (k << BITS))))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> 32, key & 0xFFFFFFFF


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each run of non-letters as one space, and one on either side of each, so that all words have boundaries; offsets."""
    parts = [b" " + t + b" " for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    data = PLAIN[np.frombuffer(b"".join(parts), np.uint8)]
    keep = data != 32
    keep[1:] |= data[:-1] != 32
    keep[offs[:-1]] = True
    kept = np.add.reduceat(keep.view(np.uint8), offs[:-1], dtype=np.int64) if len(texts) else []
    return data[keep], np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)


def distinct(text: bytes) -> np.ndarray:
    """All distinct features of one text, ascending; piece by piece, as in present()."""
    data, _ = padded([text])
    lead = max(SIZES) - 1
    found = np.zeros(0, np.int32)
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE + lead]
        for k, n in enumerate(SIZES):
            found = np.union1d(found, grams(piece, n)[:PIECE] + np.int32(k << BITS))
    return found


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(texts):
            doc, feature = present(*padded(texts), self.weights)
            total += np.bincount(doc, weights=self.weights[feature], minlength=len(texts))
        return logistic(total)


def fit(texts: list[bytes], y: np.ndarray, rounds: int = 150, ridge: float = 2e-4) -> Model:
    width = len(SIZES) << BITS
    if len(set(y)) < 2:
        return Model(np.zeros(width, np.float32), 30.0 if len(y) and y[0] else -30.0)
    in1, in0 = np.zeros(width), np.zeros(width)
    for t, label in zip(texts, y, strict=True):
        (in1 if label == 1 else in0)[distinct(t)] += 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    ratio = np.log(((in1 + 1) / (n1 + 2)) / ((in0 + 1) / (n0 + 2)))
    spread = np.sqrt(1 / (in1 + 1) + 1 / (in0 + 1))
    evidence = np.where(in1 + in0 >= 3, np.abs(ratio) / spread, 0)
    chosen = np.sort(np.argsort(-evidence, kind="stable")[:FEATURES])
    chosen = chosen[(evidence[chosen] > 3) & (np.abs(ratio[chosen]) > 0.7)]
    place = np.full(width, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    cols = [f[f >= 0] for f in (place[distinct(t)] for t in texts)]  # once more, so that only chosen features are held
    doc, col = np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols)
    r = ratio[chosen]
    w, b, m1, m2 = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):  # Adam on the whole sample
        p = logistic(np.bincount(doc, weights=(r * w)[col], minlength=len(y)) + b)
        e = p - y
        g = np.append(np.bincount(col, weights=e[doc], minlength=len(chosen)) * r / len(y) + ridge * w, e.mean())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.04 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(width, np.float32)
    weights[chosen] = r * w
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> Model:
    texts, y, _ = sample(docs, labels, target)
    model = fit(texts, y)
    del texts
    tidy(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size: len(SIZES) * 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in batches:
            data, offs = buffers(b.column(2))
            view, got = data.tobytes(), np.zeros(b.num_rows)
            at = 0
            while at < b.num_rows:  # about a piece of text at a time
                till = max(at + 1, int(np.searchsorted(offs, offs[at] + PIECE)))
                till = min(till, b.num_rows)
                got[at:till] = held.score([view[offs[i] : offs[i + 1]] for i in range(at, till)])
                at = till
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", (fold() == 0).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
