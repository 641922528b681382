"""Operator 2, near-duplicates: Order MinHash candidates, verified by banded alignment.

A text's k-mers are its five-word shingles, each labelled with the number of times that it came before in the text. A sketch holds
the PICKED k-mers that come first in a random order, in the order in which they stand in the text; texts of small edit
distance share sketches. SKETCHES sketches of a text are bands: texts that share one are held against each other.

Two texts are linked if the alignment of their labelled shingles, in text order, has L matches with L / (n_a + n_b - L) >= 0.8.
That bounds the insertions and deletions, so only matches within a band about the diagonal count; as labelled shingles are
distinct, the best alignment is the longest increasing run of matched places. For texts without transpositions and without
repeated shingles this is the Jaccard similarity of their shingles. A passage that stands twice in one text and fifty times
in the other counts as 48 insertions.

Groups, alike for buckets of any size: texts with the same labelled shingles are one text from the start. In each bucket every
text is held against the bucket's most popular one (its own buckets are largest: the original, if it is there), which is a number
of pairs in proportion to the bucket. Texts of buckets that still hold several classes are joined on their rarest
shingles, as many as it takes for any two texts at the threshold to share one: no link among them is lost, whatever the size
of the bucket. A shingle that stands in one class only is not joined at all, and the most frequent class of a shingle is not held
against itself. No cap is set: all pairs that share so much and aren't in one class yet are held against each other, so a
large group of texts that all stay just short of 0.8 takes time with the square of its size.

Two long texts of similarity 0.8 share a sketch with probability 1 - (1 - 0.8**5)**32 = 0.999997; with 20 of 25 shingles in common
it's 0.99998. Shorter ones would share fewer (4 against 5 shingles: none), so texts of SHORT shingles at most also have bands of
single shingles: those that come first in one order of all, as many as it takes for any two texts at the threshold to share one.

Edge cases: texts without words (null, empty) are copies of one another; one to four words are one shingle; documents with
equal ids are held by their own texts and get the least class of those; a null id gets a null class and no links.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WORD_MIX, buffers, cut, mapped, mix, scratch, shingles, tidy, words
from .components import components

THRESHOLD = 0.8
SKETCHES = 32
#: Texts of at most so many shingles meet in bands of single shingles as well, which lose no pair of them.
SHORT = 20
PICKED = 5
SLICE = 1 << 21
#: Shingles of a text that are ranked for all sketches at once.
AT_ONCE = 1 << 16
_SEEDS = np.random.default_rng(7).integers(1, 2**63, SKETCHES, dtype=np.uint64) | U64(1)


def labelled(s: np.ndarray) -> np.ndarray:
    """Each shingle joined with the number of times that it came before."""
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.ones(len(s), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return s
    first = np.flatnonzero(new)
    out = np.empty(len(s), U64)
    out[order] = ranked + (np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))).astype(U64) * WORD_MIX[9]
    return out


def sketch(x: np.ndarray) -> np.ndarray:
    """The Order MinHash sketches of a text's labelled shingles, each as one hash."""
    k = min(PICKED, len(x))
    out = np.empty(SKETCHES, U64)
    step = SKETCHES if len(x) <= AT_ONCE else 1
    for j in range(0, SKETCHES, step):
        rank = mix(x[None, :] * _SEEDS[j : j + step, None])
        at = np.sort(np.argpartition(rank, k - 1, axis=1)[:, :k], axis=1) if k < len(x) else np.tile(np.arange(k), (step, 1))
        out[j : j + step] = mix((x[at] * WORD_MIX[:k]).sum(axis=1, dtype=U64) + _SEEDS[j : j + step])
    return out


def longest_prefix(n: int) -> int:
    """Of n shingles in any one order, so many come first that each text at the threshold has one of them."""
    return n - math.ceil(THRESHOLD * n - 1e-9) + 1 if n else 0


def bands(x: np.ndarray) -> np.ndarray:
    """The buckets of a text: its sketches, and for a short one single shingles as well."""
    if not len(x):
        return np.zeros(0, np.int64)
    few = mix(np.sort(x)[: longest_prefix(len(x))] + WORD_MIX[20]) if len(x) <= SHORT else np.zeros(0, U64)
    return np.concatenate([sketch(x), few]).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two texts' labelled shingles; 0.0 where it's below THRESHOLD."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1) if len(b) else np.zeros(0, np.int64)
    place = order[at] if len(b) else at
    here = np.flatnonzero(b[place] == a) if len(b) else at
    if len(here) < THRESHOLD * (total - len(here)):
        return 0.0
    place = place[here]
    near = np.abs(place - here) <= total * (1 - THRESHOLD) / (1 + THRESHOLD) + 1  # the band
    place = place[near]
    if (np.diff(place) > 0).all():
        run = len(place)
    else:
        tails: list[int] = []
        for p in place.tolist():
            t = bisect_left(tails, p)
            tails[t : t + 1] = [p]
        run = len(tails)
    value = run / (total - run)
    return value if value >= THRESHOLD else 0.0


def each(texts: pa.Array) -> Iterator[np.ndarray]:
    """The labelled shingles of each text of a batch in turn."""
    data, offs = buffers(texts)
    at = 0
    while at < len(texts):
        till = min(max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE))), len(texts))
        _, _, h, first = words(data[offs[at] : offs[till]], offs[at : till + 1] - offs[at])
        s, places = shingles(h, first)
        for i in range(till - at):
            yield labelled(s[places[i] : places[i + 1]])
        at = till


def key_of(x: np.ndarray) -> tuple[int, int]:
    key = xxhash.xxh3_128_intdigest(x.tobytes())
    return (key >> 64) - 2**63, (key & (2**64 - 1)) - 2**63


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def with_ids(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (128-bit hash of the labelled shingles), n (their number), bands of each document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, held = [], [], []
            for x in each(batch.column(1)):
                keys.append(key_of(x))
                n.append(len(x))
                held.append(bands(x))
            k1, k2 = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), k1, k2, pa.array(n, pa.int64()), lists(held)], ["doc_id", "k1", "k2", "n", "bands"])

    return mapped(with_ids(docs), run, f"doc_id {dict(docs.dtypes)['doc_id']}, k1 long, k2 long, n long, bands array<long>")


def sequences(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, key, n, x (the labelled shingles) of the texts of reps(rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, size = 0, [], 0
            for x in each(batch.column(1)):
                held.append(x.view(np.int64))
                size += len(x)
                if size > SLICE:
                    yield some(batch, at, held)
                    at, held, size = at + len(held), [], 0
            yield some(batch, at, held)

    def some(batch: pa.RecordBatch, at: int, held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = pa.array([key_of(x)[0] for x in held], pa.int64()), pa.array([len(x) for x in held], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), keys, n, lists(held)], ["rep", "key", "n", "x"])

    texts = with_ids(docs).join(reps, F.col("doc_id") == F.col("rep"), "left_semi")
    return mapped(texts, run, f"rep {dict(docs.dtypes)['doc_id']}, key long, n long, x array<long>")


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """u, v, similarity of those pairs(u, v) of ids that are linked; held as from sequences()."""
    left = pairs.join(held.select(F.col("rep").alias("u"), F.col("x").alias("a")), "u")
    full = left.join(held.select(F.col("rep").alias("v"), F.col("x").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, at_a), (b, at_b) = ((c.values.to_numpy().view(U64), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
            value = np.array([aligned(a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]) for i in range(batch.num_rows)], float)
            keep = pa.array(value > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(value).filter(keep)], ["u", "v", "similarity"])

    kind = dict(held.dtypes)["rep"]
    return mapped(full, run, f"u {kind}, v {kind}, similarity double")


def buckets(banded: DataFrame) -> DataFrame:
    """bucket, rep, n, rank of texts in buckets of several; banded: rep, n, bucket. rank puts texts in large buckets first."""
    shared = cut(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    live = cut(banded.join(shared, "bucket"))
    popular = live.groupBy("rep").agg(F.sum("size").alias("popular"))
    return cut(live.join(popular, "rep").select("bucket", "rep", "n", F.struct("popular", F.xxhash64("rep").alias("tie"), "rep", "n").alias("rank")))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(rep, label) with the classes of links(u, v) made one."""
    named = links.join(labels.select(F.col("rep").alias("u"), F.col("label").alias("lu")), "u").join(labels.select(F.col("rep").alias("v"), F.col("label").alias("lv")), "v")
    same = components(named.where("lu <> lv").select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    return cut(labels.join(same.withColumnRenamed("label", "to"), F.col("label") == F.col("node"), "left").select("rep", F.coalesce("to", "label").alias("label")))


def stars(live: DataFrame) -> DataFrame:
    """u, v: each text of a bucket with the bucket's leader, where the lengths allow a link."""
    leaders = live.groupBy("bucket").agg(F.max("rank").alias("x")).select("bucket", F.col("x.rep").alias("v"), F.col("x.n").alias("m"))
    at_least = F.least("n", "m") >= F.lit(THRESHOLD) * F.greatest("n", "m")
    met = live.select("bucket", "rep", "n").join(cut(leaders), "bucket").where((F.col("rep") != F.col("v")) & at_least)
    return cut(met.select(F.least("rep", "v").alias("u"), F.greatest("rep", "v").alias("v")).distinct())


def prefixes(held: DataFrame, labels: DataFrame) -> DataFrame:
    """rep, n, h, at, label: of each text of held the shingles that come first, the rarest first, and their places in that order.

    A shingle that stands in one text only meets nothing: it is counted, but has no row."""
    every = held.select("rep", "key", "n", F.explode("x").alias("h"))
    often = cut(every.groupBy("h").agg(F.count("*").alias("often")).where("often > 1"))
    text = Window.partitionBy("rep", "key")
    place = F.col("n") - F.count("*").over(text) + F.row_number().over(text.orderBy("often", "h")) - 1
    ranked = every.join(often, "h").select("rep", "n", "h", place.alias("at"))
    size = F.col("n") - F.ceil(F.lit(THRESHOLD) * F.col("n") - F.lit(1e-9)) + 1
    return cut(ranked.where(F.col("at") < size).join(labels, "rep"))


def rare_pairs(rows: DataFrame) -> DataFrame:
    """u, v: all pairs of texts of different classes that may be linked; rows as from prefixes().

    The least number of shingles that two linked texts share follows from their lengths. The first shared one, in one order of all,
    is so early in both that it's in the prefix of the longer one and in a shorter part of the other's, with enough left after it."""
    kinds = rows.groupBy("h", "label").agg(F.count("*").alias("times")).groupBy("h").agg(F.max(F.struct("times", "label")).alias("x"), F.count("*").alias("kinds"))
    mains = cut(kinds.where("kinds > 1").select("h", F.col("x.label").alias("main")))
    rows = cut(rows.join(mains, "h"))
    a, b = (x.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "n", "at", "label", "main")]) for x, side in ((rows.where("label <> main"), "a"), (rows, "b")))
    once = (F.col("label_b") == F.col("main_b")) | (F.col("rep_a") < F.col("rep_b"))  # of pairs outside the main class one order
    least = 2 * THRESHOLD / (1 + THRESHOLD)
    shorter = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("rep_a") < F.col("rep_b"))
    n, at = F.when(shorter, F.col("n_a")).otherwise(F.col("n_b")), F.when(shorter, F.col("at_a")).otherwise(F.col("at_b"))
    early = at <= n - F.ceil(F.lit(least) * n - F.lit(1e-9))
    enough = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= F.lit(least / 2) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-9)
    met = a.join(b, (a["h"] == b["h"]) & (F.col("label_a") != F.col("label_b")) & once & early & enough)
    return cut(met.select(F.least("rep_a", "rep_b").alias("u"), F.greatest("rep_a", "rep_b").alias("v")).distinct())


def settled(live: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """labels(rep, label) of the texts of live, and the links(u, v, similarity) that made them."""
    reps = cut(live.select("rep").distinct())
    held = cut(sequences(docs, reps))
    star = cut(verified(stars(live), held))
    labels = merged(reps.withColumn("label", F.col("rep")), star)
    tidy(docs.sparkSession)
    several = live.join(labels, "rep").groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    open_ = cut(live.join(several, "bucket").select("rep").distinct())
    rows = prefixes(held.join(open_, "rep", "left_semi"), labels)
    rare = cut(verified(rare_pairs(rows), held))
    labels = merged(labels, rare)
    tidy(docs.sparkSession)
    return labels, cut(star.union(rare).groupBy("u", "v").agg(F.max("similarity").alias("similarity")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least id of the class), copies_of (the least id with the same labelled shingles) of every row; n_links,
    how many links to other texts were verified for its text, and linked_to and similarity, the most similar of these.

    Links within a class that wasn't in doubt any more aren't looked for, so n_links doesn't count all that there are."""
    docs = docs.select("doc_id", "text")
    with scratch(docs.sparkSession) as keep:
        rows = cut(sketches(docs))
        same = cut(rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("bands").alias("bands")))  # equal keys have equal bands
        members = rows.select("doc_id", "k1", "k2").join(same.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "rep")
        live = buckets(same.select("rep", "n", F.explode("bands").alias("bucket")))
        labels, links = settled(live, docs)
        ends = links.select(F.col("u").alias("rep"), F.col("v").alias("other"), "similarity").union(links.select("v", "u", "similarity"))
        best = ends.groupBy("rep").agg(F.count("*").alias("n_links"), F.max(F.struct("similarity", "other")).alias("x"))
        named = labels.join(best, "rep", "left").select("rep", "label", "n_links", F.col("x.other").alias("linked_to"), F.col("x.similarity").alias("similarity"))
        found = members.join(named, "rep", "left")
        known = found.select("doc_id", F.coalesce("label", "rep").alias("class_id"), F.col("rep").alias("copies_of"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "linked_to", "similarity")
        none = docs.where(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copies_of"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("linked_to"), F.lit(None).cast("double").alias("similarity"))
        return keep(known.unionByName(none), rows, same, labels, links)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that come first in their class (least id); rows with a null id stay.

    Of rows that repeat both id and text one stays; rows with equal ids and different texts stay or go together."""
    with scratch(docs.sparkSession) as keep:
        first = cut(classes(docs).where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("rows")))
        own = [F.col(f"`{c}`") for c in docs.columns]  # joins by name put the id first, and no other name can clash
        rest = docs.where(F.col("doc_id").isNull())
        once = docs.join(first.select("doc_id"), "doc_id", "left_semi").select(*own)
        several = first.where("rows > 1").select("doc_id")
        if several.limit(1).count():  # ids that occur again: only their rows are shuffled
            again = once.join(several, "doc_id", "left_semi").select(*own).dropDuplicates(["doc_id", "text"])
            once = once.join(several, "doc_id", "left_anti").select(*own).unionByName(again)
        return keep(once.unionByName(rest), first)
