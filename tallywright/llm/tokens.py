"""Operator 1, token counts: trie-shared dynamic programming over a fixed vocabulary.

A text is cut into pre-tokens by the vocabulary's own pattern. Each distinct pre-token is then cut into pieces of the
vocabulary with the largest sum of unigram scores. The distinct pre-tokens of a batch are put into a trie, walked depth
first: the forward score of a shared prefix is computed once, and the count of pieces is stored where a pre-token ends.
Counts are kept for later batches in a memo of bounded size.

The vocabulary is read from a byte-level file (base64 piece and rank on each line); every byte is a piece, so that each
text can be cut. No unigram scores come with it, and tokenizers aren't trained here: the score of a piece is its log
probability under Zipf's law over its rank (Mandelbrot's offset 2.7). Of cuts with equal scores that with the shorter
last piece counts. Counts are those of this unigram model, not of byte-pair merges.

Edge cases: an empty or null text has no tokens; repeated rows are counted each; pre-tokens of any length are cut whole
(those beyond LONG bytes with a sliding window instead of the trie).
"""

from __future__ import annotations

import base64
import itertools
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary cuts texts into pre-tokens. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OFFSET = 2.7
LONG = 4096
MEMO = 300_000
#: Texts are cut into pre-tokens in slices of about so many characters, at pre-token bounds.
SLICE = 1 << 20


def load_vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}
    total = math.fsum(1 / (r + OFFSET) for r in ranks.values())
    return {piece: -math.log((rank + OFFSET) * total) for piece, rank in ranks.items()}


class Counter:
    """Counts pieces of pre-tokens."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.pattern = regex.compile(PATTERN)
        self.memo: dict[str, int] = {}

    def ends(self, text: bytes, best: list[float], pieces: list[int], depth: int) -> None:
        """Forward scores of the trie's nodes below depth along text; best and pieces hold those of the path above."""
        scores, longest = self.scores, self.longest
        for d in range(depth + 1, len(text) + 1):
            top, n = -math.inf, 0
            for at in range(d - 1, max(d - longest, 0) - 1, -1):
                s = scores.get(text[at:d])
                if s is not None and (s := s + best[at]) > top:
                    top, n = s, pieces[at] + 1
            best[d], pieces[d] = top, n

    def trie(self, fresh: Iterable[str]) -> None:
        """Puts the counts of the pre-tokens into the memo: they come in the order in which a walk of their trie meets them."""
        nodes = sorted((t.encode(), t) for t in fresh)
        size = max((len(b) for b, _ in nodes), default=0) + 1
        best, pieces, path = [0.0] * size, [0] * size, b""
        for node, text in nodes:
            shared, most = 0, min(len(path), len(node))
            if node[:most] == path[:most]:
                shared = most
            else:
                while path[shared] == node[shared]:
                    shared += 1
            self.ends(node, best, pieces, shared)
            self.memo[text] = pieces[len(node)]
            path = node

    def long(self, text: bytes) -> int:
        """As ends(), with the scores of the last few prefixes only."""
        size = self.longest + 1
        best, pieces = [0.0] * size, [0] * size
        for d in range(1, len(text) + 1):
            top, n = -math.inf, 0
            for at in range(d - 1, max(d - self.longest, 0) - 1, -1):
                s = self.scores.get(text[at:d])
                if s is not None and (s := s + best[at % size]) > top:
                    top, n = s, pieces[at % size] + 1
            best[d % size], pieces[d % size] = top, n
        return pieces[len(text) % size]

    def learn(self, cut: list[list[str]]) -> None:
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.trie(t for t in {t for c in cut for t in c}.difference(self.memo) if len(t) <= LONG)

    def total(self, cut: list[str]) -> int:
        got = self.memo
        return sum(got[t] if t in got else self.long(t.encode()) for t in cut)

    def counts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Numbers of pre-tokens and of tokens of each text."""
        pre, tokens = [], []
        for group in groups(texts):
            if len(group) == 1 and len(group[0]) > SLICE:  # a part of the pre-tokens at a time
                n = total = 0
                for part in itertools.batched((m[0] for m in self.pattern.finditer(group[0])), 100_000):
                    self.learn([part])
                    n, total = n + len(part), total + self.total(part)
                pre.append(n)
                tokens.append(total)
                continue
            cut = [self.pattern.findall(t) for t in group]
            self.learn(cut)
            pre += map(len, cut)
            tokens += map(self.total, cut)
        return pre, tokens


def groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in turn, about SLICE characters at a time; a longer text alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > SLICE:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


_counters: dict[int, Counter] = {}  # a worker's memo outlives its tasks


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_pretokens, n_tokens of every row; no shuffle. Any columns but doc_id and text are ignored.

    The driver reads the vocabulary file and broadcasts it: its size is fixed, whatever the input."""
    scores = load_vocabulary(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    key = hash(vocabulary) ^ len(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(shared.value)
        for b in batches:
            pre, tokens = _counters[key].counts(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_pretokens long, n_tokens long")
