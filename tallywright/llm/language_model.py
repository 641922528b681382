"""Operator 7, LM scoring: a hashed maximum-entropy model with class-factored softmax.

P(token | history) = P(class | history) P(part | class, history) P(token | part), plus P(repeat | history) if the token is the one before it.

Classes: a word's last three bytes name one of BUCKETS buckets; buckets are clustered by what comes before their words (counted over all
training texts), so that a class is, say, the words of one language. The end of a text is a class, and so is "the same
token again". A class's tokens are dealt into PARTS by their hash. Both factors are softmaxes over n-gram and skip features:
the class's of the last bytes of earlier tokens, the part's of whole tokens, hashed with the class: the two before, and the one
before the last. A part's score starts at the log of its share of the counts, which is what it is without a history. Within a part
a token has its count + 0.5 over those of the part, with one more token for all unknown ones. Probabilities over all tokens sum to 1.

Training is distributed: texts are dealt by the hash of text and id into logical shards of about SHARD_TOKENS tokens, and a learner makes
AdaGrad updates over each shard in the order of its texts' hashes, in sparse numpy batches; the classes' weights of the shards are averaged by their
tokens, the parts' row by row by how often each shard met the row. How many shards there are and what they hold depends on the texts only,
so the model is the same however the table is partitioned, and a shard has enough to learn from on a cluster of any size. A task takes
several shards where there are many, so that sums of weights travel less than the texts. Token counts are summed over all training texts. Scoring broadcasts the model and the FREQUENT most frequent tokens' counts (all of bounded size); other tokens
meet their counts in a join. A hashed row serves all histories that fall into it, so what one rare history teaches fades as the corpus
grows; HASHED is the parameter for that.

Tokens are compared by 64-bit hashes of their lower-cased bytes.

Edge cases: null and empty texts are one end token; equal texts score alike; without training texts N and V are 0 and all classes are
equally likely; repeated rows, and rows with equal or null ids, are each learned from and scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WORD_MIX, buffers, cut, fold, mix, words

BUCKETS = 1024
COARSE = 128
CLUSTERS = 24
END, REPEAT = CLUSTERS, CLUSTERS + 1
CLASSES = CLUSTERS + 2
PAIRS = 1 << 13
SKIPS = (1, 2, 3, 5, 8)
ROWS = 4 + len(SKIPS) * BUCKETS + PAIRS
BATCH = 8192
RATE = 0.15
#: Parts of a class, and rows of weights for each kind of feature that chooses among them.
PARTS = 16
HASHED = 1 << 16
KINDS = 2
PART_RATE = 0.3
#: Training tokens of a logical shard, about 13 MB of text; tasks take one shard each up to TASKS shards, then SHARDS_A_TASK at most.
SHARD_TOKENS = 1 << 21
TASKS = 200
SHARDS_A_TASK = 16
#: At most so many tokens' counts are broadcast: 16 bytes each.
FREQUENT = 300_000
END_HASH = U64(0x1F3A5C7E9B2D4F61)
SLICE = 1 << 21


class Tokens:
    """Tokens of consecutive texts: hash, bucket, place in the text, and first[i]:first[i+1] for text i."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        starts, ends, h, at = words(data, offs)
        n = len(offs) - 1
        self.first = at + np.arange(n + 1)
        last = np.zeros(int(self.first[-1]), bool)
        last[self.first[1:] - 1] = True
        self.hash = np.full(len(last), END_HASH, U64)
        self.hash[~last] = h
        low = data.astype(np.int64)
        low[(low >= 65) & (low < 91)] += 32
        suffix = low[ends - 1] if len(ends) else np.zeros(0, np.int64)
        for k in (2, 3):
            suffix = suffix * 263 + np.where(ends - k >= starts, low[np.maximum(ends - k, 0)] if len(low) else 0, 0)
        self.bucket = np.zeros(len(last), np.int64)
        self.bucket[~last] = 2 + (suffix * 2654435761 >> 7) % (BUCKETS - 2)
        self.place = np.arange(len(last)) - np.repeat(self.first[:-1], np.diff(self.first))
        self.last = last

    def before(self, k: int) -> np.ndarray:
        """The bucket k tokens earlier in the text; 1 before its start."""
        out = np.ones(len(self.bucket), np.int64)
        if len(out) > k:
            out[k:] = np.where(self.place[k:] >= k, self.bucket[:-k], 1)
        return out

    def token_before(self, k: int) -> np.ndarray:
        """The hash of the token k places earlier in the text; that of an end before its start."""
        out = np.full(len(self.hash), END_HASH, U64)
        if len(out) > k:
            out[k:] = np.where(self.place[k:] >= k, self.hash[:-k], END_HASH)
        return out

    def part(self) -> np.ndarray:
        return (mix(self.hash ^ WORD_MIX[30]) >> U64(60)).astype(np.int64)

    def part_features(self, classes: np.ndarray) -> list[np.ndarray]:
        """A row of each kind of weights for the part of each token: of the two tokens before it, and of the one before the last."""
        last, second, own = self.token_before(1), self.token_before(2), classes.astype(U64) * WORD_MIX[31]
        return [(mix(h) >> U64(48)).astype(np.uint16) for h in (last * WORD_MIX[32] + second * WORD_MIX[33] + own, second * WORD_MIX[34] + own)]

    def repeated(self) -> np.ndarray:
        out = np.zeros(len(self.hash), bool)
        out[1:] = (self.hash[1:] == self.hash[:-1]) & (self.place[1:] > 0)
        return out

    def features(self) -> np.ndarray:
        """Rows of the weights that are active for each token, from its history only."""
        out = np.empty((len(self.hash), 2 + len(SKIPS)), np.int32)
        again = self.repeated()
        state = np.where(self.place == 0, 2, 0)
        state[1:] += again[:-1] & (self.place[1:] > 0)
        out[:, 0] = state
        earlier = [self.before(k) for k in SKIPS]
        for j, b in enumerate(earlier):
            out[:, 1 + j] = 4 + j * BUCKETS + b
        out[:, -1] = 4 + len(SKIPS) * BUCKETS + (earlier[0] * 31337 + earlier[1] * 7919) % PAIRS
        return out


def slices(column: pa.Array) -> Iterator[tuple[int, int, Tokens]]:
    data, offs = buffers(column)
    at = 0
    while at < len(offs) - 1:
        till = min(max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE))), len(offs) - 1)
        yield at, till, Tokens(data[offs[at] : offs[till]], offs[at : till + 1] - offs[at])
        at = till


def counts(texts: DataFrame) -> DataFrame:
    """kind, key, bucket, n: of each token (kind 0; bucket and part in one number) and of each bucket after each coarse bucket (kind 1),
    over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(BUCKETS * COARSE, np.int64)
        for b in batches:
            hashes, buckets, numbers = [], [], []
            for _, _, t in slices(b.column(0)):
                key, at, n = np.unique(t.hash, return_index=True, return_counts=True)
                hashes.append(key)
                buckets.append(t.bucket[at] * PARTS + t.part()[at])
                numbers.append(n)
                pairs += np.bincount(t.bucket * COARSE + t.before(1) % COARSE, minlength=len(pairs))
            if hashes:
                key, at, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate(numbers)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), np.int32)), pa.array(key.view(np.int64)), pa.array(np.concatenate(buckets)[at].astype(np.int32)), pa.array(n)], ["kind", "key", "bucket", "n"])
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int32)), pa.array(some), pa.array(np.zeros(len(some), np.int32)), pa.array(pairs[some])], ["kind", "key", "bucket", "n"])

    found = texts.mapInArrow(run, "kind int, key long, bucket int, n long")
    return found.groupBy("kind", "key").agg(F.max("bucket").alias("bucket"), F.sum("n").alias("n"))


def cluster(pairs: np.ndarray) -> np.ndarray:
    """A class for each bucket: k-means of what comes before it, as square roots of shares, weighted by its tokens."""
    weight = pairs.sum(axis=1)
    x = np.sqrt(pairs / np.maximum(weight, 1)[:, None])
    centres = [x[int(np.argmax(weight))]]
    for _ in range(CLUSTERS - 1):
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0) * np.sqrt(weight)
        centres.append(x[int(np.argmax(far))])
    c = np.array(centres)
    for _ in range(25):
        own = np.argmin(((x[:, None, :] - c[None]) ** 2).sum(axis=2), axis=1)
        for k in range(CLUSTERS):
            if weight[own == k].sum():
                c[k] = np.average(x[own == k], axis=0, weights=weight[own == k])
    own[0] = END
    return own


def softmax(weights: np.ndarray, active: np.ndarray) -> np.ndarray:
    z = weights.take(active[:, 0], axis=0)
    for j in range(1, active.shape[1]):
        z += weights.take(active[:, j], axis=0)
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def part_shares(base: np.ndarray, weights: np.ndarray, classes: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """P(part | class, history) of several tokens; base: logs of the parts' shares without a history."""
    z = base.take(classes, axis=0)
    for own, r in zip(weights, rows, strict=True):
        z += own.take(r, axis=0)
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def learn_parts(base: np.ndarray, weights: np.ndarray, squares: np.ndarray, hits: np.ndarray, classes: np.ndarray, part: np.ndarray, rows: list[np.ndarray]) -> None:
    """One AdaGrad update of the rows that a batch of tokens meets."""
    g = part_shares(base, weights, classes, rows)
    g[np.arange(len(part)), part] -= 1
    for kind, r in enumerate(rows):
        order = np.argsort(r, kind="stable")
        first = np.flatnonzero(np.append(True, r[order][1:] != r[order][:-1]))
        met, total = r[order[first]].astype(np.intp), np.add.reduceat(g.take(order, axis=0), first, axis=0)
        squared = squares[kind].take(met, axis=0) + total * total
        squares[kind][met] = squared
        weights[kind][met] -= PART_RATE * total / np.sqrt(squared)
        hits[kind][met] += np.diff(np.append(first, len(r)))


#: Rows in which the sums of classes' and of parts' weights travel.
OUTER_SLABS, INNER_SLABS = 16, 32


class Learner:
    """Learns from the texts of one shard after another, each from nothing; keeps sums of what they learned, weighted by what they met."""

    def __init__(self, class_of: np.ndarray, base: np.ndarray):
        self.class_of, self.base = class_of, base
        self.outer, self.seen_all = np.zeros((ROWS, CLASSES)), 0
        self.inner, self.hits_all = np.zeros((KINDS, HASHED, PARTS), np.float32), np.zeros((KINDS, HASHED), np.float32)
        self.start()

    def start(self) -> None:
        self.w, self.squares, self.seen = np.zeros((ROWS, CLASSES), np.float32), np.full((ROWS, CLASSES), 1e-3), 0
        self.parts, self.part_squares = np.zeros((KINDS, HASHED, PARTS), np.float32), np.ones((KINDS, HASHED, PARTS), np.float32)
        self.hits = np.zeros((KINDS, HASHED), np.float32)

    def finish(self) -> None:
        self.outer += self.w.astype(np.float64) * self.seen
        self.seen_all += self.seen
        self.inner += self.parts * self.hits[:, :, None]
        self.hits_all += self.hits
        self.start()

    def learn(self, t: Tokens) -> None:
        active, target = t.features(), self.class_of[t.bucket]
        target[t.repeated()] = REPEAT
        inside = np.flatnonzero(target < CLUSTERS)
        part, hashed = t.part(), t.part_features(target)
        for k in range(0, len(inside), BATCH):
            some = inside[k : k + BATCH]
            learn_parts(self.base, self.parts, self.part_squares, self.hits, target[some], part[some], [h[some] for h in hashed])
        total, at = np.empty((ROWS, CLASSES)), 0
        while at < len(target):  # small batches at first: a shard's first tokens teach most
            size = min(BATCH, max(128, self.seen // 8))
            rows, y = active[at : at + size], target[at : at + size]
            at += size
            g = softmax(self.w, rows)
            g[np.arange(len(y)), y] -= 1
            keys, by_class = rows.T.ravel().astype(np.intp), g.T.astype(np.float64)
            for c in range(CLASSES):
                total[:, c] = np.bincount(keys, weights=np.tile(by_class[c], rows.shape[1]), minlength=ROWS)
            self.squares += total * total
            self.w -= (RATE * total / np.sqrt(self.squares)).astype(np.float32)
            self.seen += len(y)

    def sums(self) -> pa.RecordBatch:
        sums = [*np.array_split(self.outer.ravel().astype(np.float32), OUTER_SLABS), *np.split(self.inner.ravel(), INNER_SLABS)]
        weights = [*[np.array([self.seen_all], np.float32)] * OUTER_SLABS, *np.split(self.hits_all.ravel(), INNER_SLABS)]
        return pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.list_(pa.float32())), pa.array(weights, pa.list_(pa.float32()))], ["part", "sums", "weights"])


def sharded(texts: DataFrame, total: int) -> tuple[DataFrame, int]:
    """shard, text of all rows, each shard in one task and in an order that only its rows decide; and the number of tasks."""
    shards = max(1, -(-total // SHARD_TOKENS))
    per = min(SHARDS_A_TASK, -(-shards // TASKS))
    tasks = -(-shards // per)
    rows = texts.select("text", F.xxhash64("text").alias("h"), F.pmod(F.xxhash64(*texts.columns), F.lit(shards)).cast("int").alias("shard"))
    dealt = rows.repartitionById(tasks, F.floor(F.col("shard") / per).cast("int"))
    return dealt.sortWithinPartitions("shard", "h").select("shard", "text"), tasks


def train(texts: DataFrame, total: int, class_of: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes and of parts, averaged over what was learned from each shard of texts, which have total tokens; sums
    meet in two levels of tasks. Columns of texts beside the first, text, only spread equal texts over the shards."""
    wide = KINDS * HASHED // INNER_SLABS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, now = Learner(class_of, base), None
        for b in batches:
            shard = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, z in zip(edges, edges[1:], strict=False):
                if a < z and shard[a] != now:
                    learner.finish()
                    now = shard[a]
                for _, _, t in slices(b.column(1).slice(a, z - a)):
                    learner.learn(t)
        learner.finish()
        if learner.seen_all:
            yield learner.sums()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for part, x, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                x, n = x.values.to_numpy().astype(np.float64), n.values.to_numpy().astype(np.float64)
                if part in sums:
                    sums[part][0] += x
                    sums[part][1] += n
                else:
                    sums[part] = [x, n]
        kinds = pa.list_(pa.float32())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *[pa.array([v[k].astype(np.float32) for v in sums.values()], kinds) for k in (0, 1)]], ["part", "sums", "weights"])

    schema = "part int, sums array<float>, weights array<float>"
    rows, tasks = sharded(texts, total)
    local = rows.mapInArrow(learn, schema).withColumn("group", F.spark_partition_id() % max(8, math.isqrt(tasks)))
    some = local.repartition("part", "group").select("part", "sums", "weights").mapInArrow(add, schema)
    got = some.repartition("part").mapInArrow(add, schema).toArrow()  # 48 rows: the model, of fixed size
    outer, inner = np.zeros((ROWS, CLASSES), np.float32), np.zeros((KINDS, HASHED, PARTS), np.float32)
    if not got.num_rows:
        return outer, inner
    rows = {p: (x.values.to_numpy(), n.values.to_numpy()) for p, x, n in zip(got["part"].to_pylist(), got["sums"], got["weights"], strict=True)}
    outer[:] = np.concatenate([rows[k][0] / rows[k][1][0] for k in range(OUTER_SLABS)]).reshape(ROWS, CLASSES)
    inner[:] = np.concatenate([rows[OUTER_SLABS + k][0].reshape(wide, PARTS) / np.maximum(rows[OUTER_SLABS + k][1], 1)[:, None] for k in range(INNER_SLABS)]).reshape(inner.shape)
    return outer, inner


class Model:
    """Bounded: weights, the class of each bucket, totals of parts and the most frequent tokens' counts."""

    def __init__(self, weights, inner, base, norm, class_of, frequent, frequent_n, total, distinct):
        self.weights, self.inner, self.base, self.norm, self.class_of = weights, inner, base, norm, class_of
        self.frequent, self.frequent_n, self.total, self.distinct = frequent, frequent_n, total, distinct
        self.base_norm = total + 0.5 * (distinct + 1)

    def shares(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """For each token: what a count of 1 in its part is worth, and P(repeat)."""
        cls, part, active = self.class_of[t.bucket], t.part(), t.features()
        hashed = t.part_features(cls)
        share, repeat = np.empty(len(cls)), np.empty(len(cls))
        for k in range(0, len(cls), BATCH):
            at = slice(k, k + BATCH)
            p, own = softmax(self.weights, active[at]), np.arange(len(cls[at]))
            share[at] = p[own, cls[at]]
            repeat[at] = p[:, REPEAT]
            inside = np.flatnonzero(cls[at] < CLUSTERS)
            q = part_shares(self.base, self.inner, cls[at][inside], [h[at][inside] for h in hashed])
            share[k + inside] *= q[np.arange(len(inside)), part[at][inside]]
        return share / self.norm[cls, part], repeat


def part_totals(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """norm: what the probabilities of a part's tokens are divided by; logs of the parts' shares. known: n, v of [class, part].

    The end of a text has one part, its own."""
    norm = known[:, :, 0] + 0.5 * (known[:, :, 1] + 1)
    return norm, np.log(norm / norm.sum(axis=1, keepdims=True)).astype(np.float32)


def fit(spark: SparkSession, texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and key, n of every training token. texts: text, then columns that tell equal texts apart, if there are any."""
    every = cut(counts(texts.select("text")))
    cells = every.where("kind = 1").select("key", "n").toArrow()  # BUCKETS * COARSE rows at most
    pairs = np.zeros(BUCKETS * COARSE)
    pairs[cells["key"].to_numpy()] = cells["n"].to_numpy()
    class_of = cluster(pairs.reshape(BUCKETS, COARSE))
    tokens = every.where("kind = 0").select("key", "bucket", "n")
    by_bucket = tokens.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    known = np.zeros((CLASSES, PARTS, 2))
    for r in by_bucket:
        known[class_of[r["bucket"] // PARTS], r["bucket"] % PARTS] += (r["n"], r["v"])
    total, distinct = int(known[:, :, 0].sum()), int(known[:, :, 1].sum())
    norm, base = part_totals(known)
    # the least count of which FREQUENT tokens at most have as much; counts from 4096 on are counted in powers of two
    size = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.pow(F.lit(2), F.floor(F.log2("n"))).cast("long"))
    levels = tokens.groupBy(size.alias("n")).count().collect()
    least, many = None, 0
    for r in sorted(levels, key=lambda r: -r["n"]):
        if many + r["count"] > FREQUENT:
            break
        least, many = r["n"], many + r["count"]
    if least is None:
        frequent, frequent_n = np.zeros(0, U64), np.zeros(0)
    else:
        got = tokens.where(F.col("n") >= least).select("key", "n").toArrow()
        keys = got["key"].to_numpy().view(U64)
        order = np.argsort(keys)
        frequent, frequent_n = keys[order], got["n"].to_numpy()[order].astype(float)
    weights, inner = train(texts, total, class_of, base)
    return Model(weights, inner, base, norm, class_of, frequent, frequent_n, total, distinct), tokens.select("key", "n")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    model, tokens = fit(spark, docs.where(fold() != 1).select(text, "doc_id"))
    shared = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    names = ["row", "doc_id", "key", "share", "again", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            row = b.column(0).to_numpy()
            for at, till, t in slices(b.column(2)):
                again = t.repeated()
                share, repeat = m.shares(t)
                repeat[~again] = 0
                place = np.minimum(np.searchsorted(m.frequent, t.hash), max(len(m.frequent) - 1, 0))
                common = m.frequent[place] == t.hash if len(m.frequent) else np.zeros(len(share), bool)
                n = np.where(common, m.frequent_n[place], 0.0) if len(m.frequent) else np.zeros(len(share))
                base = np.where(common, np.log10((n + 0.5) / m.base_norm), 0.0)
                own = np.where(common, np.log10(repeat + share * (n + 0.5)), 0.0)
                first = t.first[:-1]
                docs_ = np.arange(at, till)
                sums = [np.add.reduceat(x, first) for x in (common.astype(np.int64), base, own)]
                rare = np.flatnonzero(~common)
                who = np.searchsorted(t.first, rare, side="right") - 1 + at
                both = np.concatenate([docs_, who])
                nothing = np.zeros(len(rare))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row[both]), b.column(1).take(pa.array(both)),
                    # a text's own sums travel under its row number, so that they're spread; a share of -1 marks them
                    pa.array(np.concatenate([row[docs_], t.hash[rare].view(np.int64)])),
                    pa.array(np.concatenate([np.full(len(docs_), -1.0), share[rare]])), pa.array(np.concatenate([np.zeros(len(docs_)), repeat[rare]])),
                    pa.array(np.concatenate([np.diff(t.first), nothing.astype(np.int64)])), pa.array(np.concatenate([sums[0], nothing.astype(np.int64)])),
                    pa.array(np.concatenate([sums[1], nothing])), pa.array(np.concatenate([sums[2], nothing])),
                ], names)

    parts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text).mapInArrow(run, f"row long, doc_id {kind}, key long, share double, again double, n_tokens long, n_known long, base_score double, score double")
    rare = F.col("share") >= 0
    n = F.coalesce("n", F.lit(0))
    met = parts.join(tokens.hint("shuffle_merge"), "key", "left").select(
        "row", "doc_id", "n_tokens",
        F.when(rare, (n > 0).cast("long")).otherwise(F.col("n_known")).alias("n_known"),
        F.when(rare, F.log10((n + 0.5) / F.lit(float(model.base_norm)))).otherwise(F.col("base_score")).alias("base_score"),
        F.when(rare, F.log10(F.col("again") + F.col("share") * (n + 0.5))).otherwise(F.col("score")).alias("score"),
    )
    out = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return out.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
