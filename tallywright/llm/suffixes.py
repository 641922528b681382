"""Operator 6, suffix-array dedup: depth-limited radix sort of suffixes, by most-significant-digit passes.

A window is T units (bytes or words) of a text; the order of suffixes through T units puts equal windows side by side. That order is
made digit by digit, and only groups that still have several members go on to the next pass, as in a radix sort:

pass 0  The digit is the K-unit gram with the least hash in the window (leftmost of ties). Neighbouring windows share it, so a whole run
        of windows is one row: about 2 / (T - K + 2) rows a unit instead of one. Equal windows have equal digits at equal places.
pass 1  Runs whose digit occurs with differing surroundings are cut into blocks of STEP windows, at fixed distances from the digit; the new
        digit is all that the block's windows have in common, T - STEP + 1 units.
pass 2  Blocks that still differ are cut into single windows; the digit is the window itself, so each group is exactly one repeated window.

In each pass, rows with the same digit and the same units throughout are the same windows: all but the first (least id, then
place) are repeats. Runs that a text repeats are one row with all their places, and each distinct run goes on once, so a passage
that a third of all texts contain, or a line that fills a text, costs one row a text and pass. Groups are counted by partial
aggregates, written, and joined by sort-merge joins that adaptive execution splits; no group is ever gathered in a
task. Digits and runs are compared by 64-bit hashes each (128 bits for a run).

Edge cases: null and empty texts have no windows; texts shorter than T lose nothing; a null id is never compared and loses nothing.
Rows with equal ids and equal texts are one document, so all of them keep the same; texts that differ under one id are documents of
their own, in the order of a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, PIECE, U64, WORD_MIX, buffers, cut, mapped, mix, power_tables, scratch, tidy, words

BYTES, BYTE_GRAM = 100, 20
WORDS, WORD_GRAM = 50, 10
#: Windows in a block of pass 1.
STEP = 10


class Sums:
    """Prefix sums of a piece of units, for the hash of any span."""

    def __init__(self, values: np.ndarray):
        self.power, self.inverse = power_tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.power[: len(values)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width neighbours."""
    have = 1
    while have * 2 <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if have < width else keys


def runs(values: np.ndarray, size: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pass 0 for one text: digit, units, start, shape of each run. shape: windows << 16 | distance from start to digit.

    Goes through long texts in pieces; a run that a piece's end cuts is two rows, which later passes compare window by window."""
    for at in range(0, len(values) - size + 1, PIECE):
        piece = values[at : at + PIECE + size - 1]
        sums = Sums(piece)
        begin = np.arange(len(piece) - gram + 1)
        digit = mix(sums.spans(begin, begin + gram))
        low = U64((1 << 20) - 1)
        own = (least((digit & ~low) | begin.astype(U64), size - gram + 1) & low).astype(np.int64)  # the digit's place, for each window
        first = np.flatnonzero(np.diff(own, prepend=-1))
        count = np.diff(np.append(first, len(own)))
        place = own[first]
        shape = (count << 16) | (place - first)
        units = mix(sums.spans(first, first + count - 1 + size) + shape.astype(U64) * WORD_MIX[11])
        yield digit[place], units, first + at, shape


def collapsed(units: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one owner with equal units as one: the order of rows, by owner and units and otherwise as they came, and in that order
    where each group of equal ones starts and ends."""
    order = np.lexsort((units, owner))
    new = np.ones(len(order), bool)
    new[1:] = (units[order][1:] != units[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    first = np.flatnonzero(new)
    return order, first, np.append(first[1:], len(order))


def split(values: np.ndarray, offs: np.ndarray, shapes: np.ndarray, size: int, step: int) -> tuple[np.ndarray, ...]:
    """Blocks of step windows of many runs: digit, units, offset in the run, shape, and the run's number.

    values: the units of all runs one after another; run i has offs[i]:offs[i + 1]."""
    count, lead = shapes >> 16, shapes & 0xFFFF
    run = np.repeat(np.arange(len(shapes)), count)
    j = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)  # window j starts lead - j units before the digit
    block = (lead[run] - j) // step
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(run)))
    run, j, block = run[first], j[first], block[first]
    sums, base = Sums(values), offs[run]
    nearest = base + lead[run] - block * step  # start of the last window of a whole block
    core = mix(sums.spans(nearest, nearest - step + 1 + size) + block.view(U64) * WORD_MIX[12])
    shape = (many << 16) | (lead[run] - j)
    units = mix(sums.spans(base + j, base + j + many - 1 + size) + shape.view(U64) * WORD_MIX[13])
    return core, units, j, shape, run


class Kind:
    """How texts are read as units."""

    def __init__(self, by_words: bool):
        self.by_words = by_words
        self.size, self.gram = (WORDS, WORD_GRAM) if by_words else (BYTES, BYTE_GRAM)

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Units of each text: word hashes, or bytes."""
        data, offs = buffers(column)
        if not self.by_words:
            for a, b in zip(offs, offs[1:], strict=False):
                yield data[a:b]
            return
        at = 0
        while at < len(column):
            till = min(max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 21)))), len(column))
            _, _, h, first = words(data[offs[at] : offs[till]], offs[at : till + 1] - offs[at])
            for i in range(till - at):
                yield h[first[i] : first[i + 1]]
            at = till

    def values(self, units: np.ndarray) -> np.ndarray:
        return units if self.by_words else BYTE_VALUE[units]

    def from_bytes(self, raw: np.ndarray) -> np.ndarray:
        return self.values(raw.view(U64) if self.by_words else raw)


ROW = "digit long, units long, id {}, at int, shape int, later array<int>, parent int"
NAMES = ["digit", "units", "id", "at", "shape", "later", "parent"]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U64).view(np.int64) if x.dtype != np.int64 else x, pa.int64())


def rows_batch(ids: pa.Array, digit: np.ndarray, units: np.ndarray, owner: np.ndarray, at: np.ndarray, shape: np.ndarray, parent: np.ndarray) -> pa.RecordBatch:
    """Rows of a pass: at is the first place of a run in its text, later holds its other places there; null where there are none."""
    order, first, end = collapsed(units, owner)
    one = order[first]
    more = end - first - 1
    rest = np.ones(len(order), bool)
    rest[first] = False
    offsets = pa.array(np.append(0, np.cumsum(more)).astype(np.int32), pa.int32(), mask=np.append(more == 0, False))
    later = pa.ListArray.from_arrays(offsets, pa.array(at[order[rest]].astype(np.int32)))
    return pa.RecordBatch.from_arrays([signed(digit[one]), signed(units[one]), ids.take(pa.array(owner[one])), pa.array(at[one].astype(np.int32)), pa.array(shape[one].astype(np.int32)), later, pa.array(parent[one].astype(np.int32))], NAMES)


def first_rows(docs: DataFrame, kind: Kind) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, which, size = [], [], 0

            def batch() -> pa.RecordBatch:
                digit, units, at, shape = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(4))  # noqa: B023
                owner = np.repeat(np.array(which, np.int64), [len(p[0]) for p in parts]) if parts else np.zeros(0, np.int64)  # noqa: B023
                return rows_batch(b.column(0), digit, units, owner, at, shape, at)  # noqa: B023

            for i, units in enumerate(kind.texts(b.column(1))):
                if len(units) < kind.size:
                    continue
                for part in runs(kind.values(units), kind.size, kind.gram):
                    parts.append(part)
                    which.append(i)
                    size += len(part[0])
                    if size > 200_000:
                        yield batch()
                        parts, which, size = [], [], 0
            yield batch()

    return mapped(docs, run, ROW.format(dict(docs.dtypes)["id"]))


def sort_pass(rows: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """rows are read twice; those of pass 0 are computed twice rather than stored, as they are many and few stay.

    Repeats (id, ats, shape), and for the next pass the first (id, at, shape, parent) of each distinct run in a group of several."""
    places = F.lit(1) + F.coalesce(F.size("later"), F.lit(0))
    groups = cut(rows.groupBy("digit").agg(F.sum(places).alias("n"), F.min("units").alias("low"), F.max("units").alias("high")).where("n > 1").select("digit", (F.col("low") != F.col("high")).alias("differ")))
    again = cut(rows.join(groups.hint("shuffle_merge"), "digit"))
    firsts = again.groupBy("digit", "units").agg(F.min(F.struct("id", "at", "parent")).alias("x"), F.max("shape").alias("shape"), F.sum(places).alias("n"), F.first("differ").alias("differ"))
    firsts = cut(firsts.select("digit", "units", "x.id", "x.at", "x.parent", "shape", "n", "differ"))
    several = firsts.where("n > 1").select("digit", "units", F.col("id").alias("_id"), F.col("at").alias("_at"))
    is_first = (F.col("id") == F.col("_id")) & (F.col("at") == F.col("_at"))
    repeats = again.join(several.hint("shuffle_merge"), ["digit", "units"]).where(~is_first | F.col("later").isNotNull())
    every = F.concat(F.array("at"), F.coalesce("later", F.array().cast("array<int>")))
    repeats = repeats.select("id", F.when(is_first, F.col("later")).otherwise(every).alias("ats"), "shape")
    return cut(repeats), None if last else firsts.where("differ").select("id", "at", "shape", "parent")


def snippets(docs: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """The units of the wanted runs, as bytes."""
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("at", "shape")).alias("runs"))  # as many as the text has runs, at most
    held = docs.join(lists.hint("shuffle_merge"), "id").select("id", "text", F.col("runs.at").alias("ats"), F.col("runs.shape").alias("shapes"))
    wide = 8 if kind.by_words else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, which, ats, shapes, size = [], [], [], [], 0

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), pa.array(ats, pa.int32()), pa.array(shapes, pa.int32()), pa.array(out, pa.binary())], ["id", "at", "shape", "units"])  # noqa: B023

            for i, units in enumerate(kind.texts(b.column(1))):
                raw = units.tobytes()
                for at, shape in zip(b.column(2)[i].as_py(), b.column(3)[i].as_py(), strict=True):
                    out.append(raw[at * wide : (at + (shape >> 16) - 1 + kind.size) * wide])
                    which.append(i)
                    ats.append(at)
                    shapes.append(shape)
                    size += len(out[-1])
                if size > 1 << 23:
                    yield batch()
                    out, which, ats, shapes, size = [], [], [], [], 0
            yield batch()

    return mapped(held, run, f"id {dict(docs.dtypes)['id']}, at int, shape int, units binary")


def split_rows(pieces: DataFrame, kind: Kind, step: int) -> DataFrame:
    """Rows of the next pass, from runs with their units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = buffers(b.column(3))
            if not b.num_rows:
                continue
            units_at = offs // (8 if kind.by_words else 1)
            core, units, at, shape, which = split(kind.from_bytes(data), units_at, b.column(2).to_numpy().astype(np.int64), kind.size, step)
            parent = b.column(1).to_numpy()[which]
            yield rows_batch(b.column(0), core, units, which, at + parent, shape, parent)

    return mapped(pieces, run, ROW.format(dict(pieces.dtypes)["id"]))


def narrowed(pieces: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """The units of wanted blocks, out of the runs that they were cut from."""
    wide = 8 if kind.by_words else 1
    whole = pieces.select("id", F.col("at").alias("parent"), "units").hint("shuffle_merge")
    start, length = (F.col("at") - F.col("parent")) * wide + 1, (F.shiftright("shape", 16) - 1 + kind.size) * wide
    return wanted.join(whole, ["id", "parent"]).select("id", "at", "shape", F.substring("units", start, length).alias("units"))


def repeats(docs: DataFrame, by_words: bool = False) -> DataFrame:
    """id, ats, windows: runs of windows, in units, that also start earlier. docs has id and text."""
    kind = Kind(by_words)
    with scratch(docs.sparkSession) as keep:
        docs = docs.where(F.col("id").isNotNull())
        found, wanted = sort_pass(first_rows(docs, kind), last=False)
        tidy(docs.sparkSession)
        pieces = cut(snippets(docs, wanted, kind))
        more, wanted = sort_pass(cut(split_rows(pieces, kind, STEP)), last=False)
        tidy(docs.sparkSession)
        blocks = cut(narrowed(pieces, wanted, kind))
        single, _ = sort_pass(cut(split_rows(blocks, kind, 1)), last=True)
        every = found.unionByName(more).unionByName(single)
        return keep(every.select("id", "ats", F.shiftright("shape", 16).alias("windows")), found, more, single)


def covered(ats: np.ndarray, counts: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [start, end) of units, from runs of repeated windows."""
    order = np.argsort(ats, kind="stable")
    start, end = ats[order], np.minimum(ats[order] + counts[order] - 1 + size, length)
    start, end = start[start < end], end[start < end]
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def with_spans(docs: DataFrame, by_words: bool) -> DataFrame:
    """docs, which has id and text, with the lists of starts and numbers of repeated windows."""
    if docs.where(F.col("id").isNotNull()).groupBy("id").count().where("count > 1").limit(1).count():
        docs = docs.withColumn("id", F.when(F.col("id").isNotNull(), F.struct("id", F.xxhash64("text").alias("tie"))))
        texts = docs.select("id", "text").dropDuplicates(["id"])
    else:
        texts = docs.select("id", "text")
    spans = repeats(texts, by_words).groupBy("id").agg(F.collect_list(F.struct("ats", "windows")).alias("s")).select(F.col("id").alias("_id"), F.flatten("s.ats").alias("_ats"), F.flatten(F.transform("s", lambda x: F.array_repeat(x["windows"], F.size(x["ats"])))).alias("_windows"))
    return docs.join(spans.hint("shuffle_merge"), F.col("id") == F.col("_id"), "left").drop("_id")


def _numbers(cell: pa.Scalar) -> np.ndarray:
    return cell.values.to_numpy() if cell.is_valid else np.zeros(0, np.int64)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: bytes that 100-byte repeats cover are removed."""
    texts = docs.select("doc_id", F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = buffers(b.column(1))
            n, removed, spans, shas = np.diff(offs), [], [], []
            for i in range(b.num_rows):
                text = data[offs[i] : offs[i + 1]]
                start, end = covered(_numbers(b.column(2)[i]), _numbers(b.column(3)[i]), BYTES, len(text))
                removed.append(int((end - start).sum()))
                spans.append(len(start))
                h, at = hashlib.sha256(), 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    h.update(text[at:s].tobytes())
                    at = e
                h.update(text[at:].tobytes())
                shas.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    held = with_spans(texts, False).select("doc_id", "text", "_ats", "_windows")
    return mapped(held, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the words cut out that repeats of 50 words cover, all but their first occurrence; texts left empty are dropped.

    n_chars, where there is such a column, is counted anew for changed texts."""
    columns = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    at_text, at_chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else -1
    held = with_spans(renamed, True)
    place = {c: i for i, c in enumerate(held.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep, chars = b.column(at_text).to_pylist(), np.ones(b.num_rows, bool), b.column(at_chars).to_pylist() if at_chars >= 0 else None
            for i in range(b.num_rows):
                ats = _numbers(b.column(place["_ats"])[i])
                if not len(ats):
                    continue
                raw = texts[i].encode()
                begin, _, _, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                start, end = covered(ats, _numbers(b.column(place["_windows"])[i]), WORDS, len(begin))
                bounds, at, left = np.append(begin, len(raw)), 0, []
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    left.append(raw[at : bounds[s]])
                    at = int(bounds[e])
                texts[i] = b"".join([*left, raw[at:]]).decode()
                keep[i] = bool(texts[i].strip())
                if chars:
                    chars[i] = len(texts[i])
            arrays = [b.column(i) for i in range(len(columns))]
            arrays[at_text] = pa.array(texts, arrays[at_text].type)
            if chars:
                arrays[at_chars] = pa.array(chars, arrays[at_chars].type)
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(keep))

    return mapped(held, run, docs.schema)
