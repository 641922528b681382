"""Operator 8, quality classifier: zstandard dictionaries of good and of bad text.

A dictionary is built from good labelled texts and one from bad ones. A text is compressed with each; the normalised
difference of the compressed sizes, and how far each size is below the text's own, become a probability through a
logistic calibration fitted on labelled texts that neither dictionary has seen.

Labels are learned from whole texts of a bounded sample of rows (labelled.py). Each dictionary is trained on texts of its class; where
the trainer finds too little to work with, it is the newest DICTIONARY_BYTES of these texts themselves.

Edge cases: an empty or null text is scored like any other, from the sizes that the compressor gives it; equal texts score alike;
without any training label of one class every text gets the other class's score (0.5 if there are no labels at all).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, fold, mapped, tidy
from .labelled import sample

DICTIONARY_BYTES = 110_000
LEVEL = 3
THRESHOLD = 0.3


class Model:
    """Two dictionaries and the calibration; small enough to travel with each task (about 0.2 MB)."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, constant: float | None = None):
        self.good, self.bad, self.weights, self.mean, self.scale, self.constant = good, bad, weights, mean, scale, constant
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def sizes(self, text: bytes) -> tuple[int, int]:
        if self._pair is None:
            kind = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self._pair = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **kind) for d in (self.good, self.bad)]
        return len(self._pair[0].compress(text)), len(self._pair[1].compress(text))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        x = features(np.array([(*self.sizes(t), len(t)) for t in texts], float))
        return logistic(((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0])

    def score_column(self, texts: pa.Array) -> np.ndarray:
        """Scores of an Arrow column; the texts aren't copied."""
        data, offs = buffers(texts)
        view, ends = memoryview(data), offs.tolist()
        return self.score([view[a:b] for a, b in zip(ends, ends[1:], strict=False)])


def features(sizes: np.ndarray) -> np.ndarray:
    """From compressed sizes (good, bad) and byte lengths: the normalised difference and both ratios, with squares."""
    good, bad, n = sizes.T
    base = np.stack([(bad - good) / np.maximum(np.maximum(good, bad), 1), good / np.maximum(n, 1), bad / np.maximum(n, 1)], axis=1)
    base = np.clip(base, -1.5, 1.5)
    return np.hstack([base, base**2, base[:, :1] * base[:, 1:], 1 / np.log2(n + 2)[:, None]])


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Newton's method; the intercept comes first and isn't shrunk."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(rounds):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of too little text, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [t for t in texts if t]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:] or b"\n" * 8


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    texts, y, split = sample(docs, labels, target)
    if len(set(y)) < 2:
        return Model(b"", b"", np.zeros(1), np.zeros(1), np.ones(1), float(y[0]) if len(y) else 0.5)
    held = split % 3 == 0  # for the calibration
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    learn = ~held
    good, bad = (dictionary([texts[i] for i in np.flatnonzero(learn & (y == c))]) for c in (1, 0))
    model = Model(good, bad, np.zeros(1), np.zeros(1), np.ones(1))
    at = np.flatnonzero(held if held.any() else learn)
    x = features(np.array([(*model.sizes(texts[i]), len(texts[i])) for i in at], float))
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = fit_logistic((x - model.mean) / model.scale, y[at].astype(float))
    del texts
    tidy(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; only doc_id and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.score_column(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return mapped(docs.select("doc_id", (fold() == 0).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text")), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at or above the threshold, with all their columns."""
    model = train(docs, labels)
    names = docs.columns
    position = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score_column(b.column(position)) >= threshold))

    return mapped(docs, run, docs.schema)
