"""Operator 5, benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

A window of a text has as many five-word shingles as the benchmark item it is held against. Windows are opened only where the text has as
many of the item's shingles as THRESHOLD takes: any window at the threshold does, so none is missed. A window's 64-bit SimHash is looked
up in eight 8-bit blocks, each listing the items of this size whose block differs in two bits at most; by the pigeonhole
principle that finds every item within RADIUS bits. Those within it are verified exactly: shingles weighted by how
often they occur, the sum of lesser weights over the sum of greater weights must reach THRESHOLD.

What the index doesn't find isn't found. A window at the threshold differs in some 9 bits, with a deviation below 3, so that RADIUS 23 leaves
out about one of a million; the tests measure recall against the exact rule.

The benchmark is taken in blocks of at most BLOCK_BYTES bytes and BLOCK_ITEMS items (a query set against all rows); each block is one pass over the
texts, with a broadcast of bounded size. Of several blocks one is held at a time: what a block finds is written before its
broadcast is given back and the next block is read.

Edge cases: words as in common.py; an item of one to four words is one shingle of that many words and is looked for among all such runs
of words; items without words match nothing; a text
shorter than an item is one window; repeated items and rows each count; a null id is kept as null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, U64, buffers, cut, mapped, shingles, words

THRESHOLD = 0.8
RADIUS = 23
#: Blocks of a fingerprint, and bits of each.
PARTS = 8
BITS = 64 // PARTS
#: Bytes of text and number of benchmark items in a pass: tables of some 60 MB at most.
BLOCK_BYTES = 1 << 22
BLOCK_ITEMS = 5000
#: Bytes of documents that are hashed at a time.
SLICE = 1 << 21
_BITS = np.arange(64, dtype=np.uint64)


def near_values(reach: int = RADIUS // PARTS) -> np.ndarray:
    """All masks of a block with at most reach bits."""
    every = np.arange(1 << BITS, dtype=np.uint32)
    return every[np.bitwise_count(every) <= reach].astype(np.int64)


def simhash(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of size shingles at starts; a shingle that occurs twice weighs twice."""
    if not len(starts):
        return np.zeros(0, U64)
    low = int(starts[0])
    span = hashes[low : int(starts[-1]) + size]
    ones = np.zeros((len(span) + 1, 64), np.int32)
    np.cumsum(((span[:, None] >> _BITS) & U64(1)).astype(np.int32), axis=0, out=ones[1:])
    at = starts - low
    return (((ones[at + size] - ones[at]) * 2 > size).astype(U64) << _BITS).sum(axis=1, dtype=U64)


class Index:
    """Items of one block of the benchmark."""

    def __init__(self, ids: list, texts: list[str]):
        data, offs = buffers(pa.array(texts, pa.large_string()))
        _, _, h, first = words(data, offs)
        s, at = shingles(h, first)
        self.ids = ids
        self.size = np.diff(at)
        self.words = np.diff(first)
        #: Numbers of words of items that are shorter than a shingle.
        self.short = sorted({n for n in self.words.tolist() if 0 < n < SHINGLE})
        for n in self.short:
            own, own_at = shingles(h, first, n)
            some = np.flatnonzero(self.words == n)
            s[at[some]] = own[own_at[some]]
        owner = np.repeat(np.arange(len(texts)), self.size)
        order = np.lexsort((owner, s))
        new = np.ones(len(s), bool)
        new[1:] = (s[order][1:] != s[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        self.shingle, self.owner = s[order][new], owner[order][new]  # each shingle of an item once
        self.counts = [Counter(s[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
        self.finger = np.array([simhash(s[a:b], np.zeros(1, np.int64), int(b - a))[0] if b > a else 0 for a, b in zip(at, at[1:], strict=False)], U64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[s >> U64(44)] = True
        self.blocks: dict[int, tuple[np.ndarray, list]] = {}

    def of_size(self, size: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Items of this size, and for each block the bounds of each value's list of them; made when it's first asked for."""
        if size not in self.blocks:
            items, masks, parts = np.flatnonzero(self.size == size).astype(np.int32), near_values(), []
            for p in range(PARTS):
                keys = (self._block(self.finger[items], p)[:, None] ^ masks[None, :]).ravel()
                order = np.argsort(keys, kind="stable")
                bounds = np.searchsorted(keys[order], np.arange((1 << BITS) + 1)).astype(np.int32)
                parts.append((bounds, items[order // len(masks)]))
            self.blocks[size] = items, parts
        return self.blocks[size]

    @staticmethod
    def _block(prints: np.ndarray, p: int) -> np.ndarray:
        return ((prints >> U64(BITS * p)) & U64((1 << BITS) - 1)).astype(np.int64)

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows (places in prints) and items of this size whose fingerprints differ in RADIUS bits at most."""
        n = len(self.ids)
        pairs = []
        for p, (bounds, lists) in enumerate(self.of_size(size)[1]):
            value = self._block(prints, p)
            lo, many = bounds[value].astype(np.int64), (bounds[value + 1] - bounds[value]).astype(np.int64)
            w = np.repeat(np.arange(len(prints)), many)
            pairs.append(w * n + lists[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(w))])
        w, i = np.divmod(np.unique(np.concatenate(pairs)), n)
        near = np.bitwise_count(prints[w] ^ self.finger[i]) <= RADIUS
        return w[near], i[near]

    def needed(self, width: np.ndarray | int, size: np.ndarray | int) -> np.ndarray:
        """How many shingles a window of width shingles must have in common with an item of size shingles."""
        return np.maximum(np.ceil(THRESHOLD / (1 + THRESHOLD) * (width + size) - 1e-9).astype(np.int64), 1)

    def matches(self, h: np.ndarray) -> list[tuple[int, int, float]]:
        """(item, first shingle of the best window, similarity) of each item that the shingles of one text contain."""
        hits = np.flatnonzero(self.maybe[h >> U64(44)])
        if len(hits):
            at = np.searchsorted(self.shingle, h[hits])
            hits = hits[self.shingle[np.minimum(at, len(self.shingle) - 1)] == h[hits]]
        if not len(hits):
            return []
        value, times = np.unique(h[hits], return_counts=True)
        low, high = np.searchsorted(self.shingle, value), np.searchsorted(self.shingle, value, side="right")
        many = high - low
        entry = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        total = np.bincount(self.owner[entry], weights=np.repeat(times, many), minlength=len(self.ids))
        able = total >= self.needed(np.minimum(self.size, len(h)), self.size)  # the others have no window at the threshold
        out = []
        for size in np.unique(self.size[able]).tolist():
            own = able & (self.size == size)
            width = min(size, len(h))
            common = np.unique(self.shingle[entry[own[self.owner[entry]]]])
            places = hits[np.isin(h[hits], common)]
            near: dict[int, list[int]] = {}
            for a, b in windows(places, int(self.needed(width, size)), width, len(h)):
                step = max(16, min(4096, (1 << 20) // len(self.of_size(size)[0])))  # bounded scratch space
                for k in range(a, b + 1, step):
                    run = np.arange(k, min(k + step, b + 1))
                    w, i = self.candidates(simhash(h, run, width), size)
                    for x, start in zip(i[own[i]].tolist(), run[w[own[i]]].tolist(), strict=True):
                        near.setdefault(x, []).append(start)
            for i, starts in near.items():
                best, at = 0.0, 0
                for some in np.split(np.array(starts), np.flatnonzero(np.diff(starts) > width) + 1):
                    a = int(some[0])
                    got, start = best_window(h[a : int(some[-1]) + width].tolist(), width, self.counts[i], size, {x - a for x in some.tolist()})
                    if got > best:
                        best, at = got, a + start
                if best >= THRESHOLD:
                    out.append((i, at, best))
        return sorted(out)


def windows(places: np.ndarray, need: int, width: int, n: int) -> Iterator[tuple[int, int]]:
    """First and last start of each run of windows of width shingles, of n, that have at least need of the places."""
    if len(places) < need:
        return
    first, last = np.maximum(places[need - 1 :] - width + 1, 0), np.minimum(places[: len(places) - need + 1], n - width)
    some = first <= last
    yield from joined(first[some].tolist(), last[some].tolist())


def joined(first: list[int], last: list[int]) -> Iterator[tuple[int, int]]:
    """The union of spans, whose bounds both ascend, as spans that don't meet."""
    now: tuple[int, int] | None = None
    for a, b in zip(first, last, strict=True):
        if now and a <= now[1] + 1:
            now = now[0], max(now[1], b)
        else:
            if now:
                yield now
            now = a, b
    if now:
        yield now


def best_window(h: list[int], width: int, item: Counter, size: int, starts: set[int] | None = None) -> tuple[float, int]:
    """Greatest similarity of the windows of a run of shingles, or of those at starts, and the first start that has it; one step a shingle."""
    have: Counter = Counter()
    both, most, at = 0, -1, 0
    for k, x in enumerate(h):
        if x in item:
            both += have[x] < item[x]
            have[x] += 1
        if k >= width and (old := h[k - width]) in item:
            have[old] -= 1
            both -= have[old] < item[old]
        if k >= width - 1 and both > most and (starts is None or k - width + 1 in starts):
            most, at = both, k - width + 1
    return most / (width + size - most), at


def similarity(window: list[int], item: Counter, size: int) -> float:
    """Sum of the lesser counts of each shingle over the sum of the greater counts."""
    both = sum(min(n, item[x]) for x, n in Counter(window).items() if x in item)
    return both / (len(window) + size - both)


def blocks(benchmark: DataFrame) -> Iterator[tuple[Index, int]]:
    """The benchmark in blocks of bounded size, read one at a time; with the number of blocks."""
    items = benchmark.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.regexp_like("text", F.lit("[^ \\t-\\r]")))
    n = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    count = max(1, -(-n["b"] // BLOCK_BYTES), -(-n["n"] // BLOCK_ITEMS))
    for k in range(count if n["n"] else 0):
        part = (items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)).toArrow()
        ids, texts = part["item_id"].combine_chunks(), part["text"].to_pylist()
        if texts:
            keys = ids.to_pylist()
            order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i], texts[i]))
            yield Index(ids.take(pa.array(order)), [texts[i] for i in order]), count


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of the best window of each item that a document contains."""
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, first_word long, n_words long"
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for index, count in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(doc, *x) for doc, x in found(shared.value, b.column(1))]
                ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                item = shared.value.ids.take(pa.array([r[1] for r in rows], pa.int64()))
                numbers = [pa.array([r[c] for r in rows], t) for c, t in ((3, pa.float64()), (2, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, item, *numbers], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = mapped(text, run, schema)
        if count > 1:
            part = cut(part)
            shared.unpersist()
        out = out.unionByName(part)
    return out


def found(index: Index, texts: pa.Array) -> Iterator[tuple[int, tuple[int, int, float, int]]]:
    """(row, (item, first word, similarity, words of the window)) of each match in a batch of texts."""
    data, offs = buffers(texts)
    at = 0
    while at < len(texts):  # bounded scratch space
        till = min(max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE))), len(texts))
        _, _, h, first = words(data[offs[at] : offs[till]], offs[at : till + 1] - offs[at])
        for size in (SHINGLE, *index.short):
            s, places = shingles(h, first, size)
            likely = np.add.reduceat(np.append(index.maybe[s >> U64(44)], False), places[:-1]) if len(s) else np.zeros(till - at)
            for i in np.flatnonzero((likely > 0) & (np.diff(places) > 0)):
                n = int(first[i + 1] - first[i])
                for item, start, value in index.matches(s[places[i] : places[i + 1]]):
                    yield at + int(i), (item, start, value, min(n, int(index.words[item])))
        at = till


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no benchmark item, with all their columns; no shuffle, but for a benchmark of several blocks."""
    position = docs.columns.index("text")
    key = [F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")]  # rows of equal texts go together
    bad = None
    for index, count in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], hit: bool, at: int, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held = np.zeros(b.num_rows, bool)
                held[[i for i, _ in found(shared.value, b.column(at))]] = True
                yield b.filter(pa.array(held == hit))

        if count == 1:
            return mapped(docs, lambda batches: run(batches, False, position), docs.schema)  # noqa: B023
        text = docs.select("text").where("text IS NOT NULL")
        part = cut(mapped(text, lambda batches: run(batches, True, 0), text.schema).select(key[0].alias("_a"), key[1].alias("_b")).distinct())  # noqa: B023
        shared.unpersist()
        bad = part if bad is None else bad.union(part)
    if bad is None:
        return docs
    bad = bad.distinct()
    return docs.join(bad, (key[0] == bad["_a"]) & (key[1] == bad["_b"]), "left_anti")
