"""The most similar path to each claimed one, by difflib's ratio, without taking the ratio of all with all.

A ratio of r over texts of n and m characters means r / 2 * (n + m) characters matched in order, so the texts have as many characters in common, repeats
counted, and a common subsequence as long. Each text's characters, with the number of the same before them, are bits of a signature of WORDS words: bits of
one text that the other hasn't are characters that can't be matched. Texts are sorted by length and letters and packed into blocks with the bits that any and
that all of them have. Blocks meet blocks; pairs of blocks without a text in reach are left out before anything is read from them, within the others groups of
GROUP texts are left out by the same bound, then single pairs by their bits, then by the length of their longest common subsequence; only the rest gets a
ratio. Pairs are never written or shuffled: a task keeps the two best of each of its claims. No pair is lost, as every bound is one from above.

Where blocks leave many pairs in reach, these come from an index of segments instead. A pair of ratio above r has at most D = (1 - r) * (n + m) characters without
counterpart; a path is cut into D + 1 segments, so one of them is whole in the claim: the first before whose end lie fewer such characters than segments. Before
it there are as many of them as segments, which leaves it few places (_shifts). Where a length's paths are cut is what makes equal segments least likely. Pairs
with a segment in common go on to the bounds by bits and subsequence; claims for which that'd be more work than all pairs' bits meet whole blocks as before.

Claims in blocks of which no block of paths is in reach at the least ratio leave before the search; for that only the blocks' lengths and bits are compared.

A claim's outcome is its best path and whether another comes within MARGIN of it. Levels of falling ratios therefore settle first the claims that have near
paths; only claims without any go down to the last level. What a claim still needs (its best less MARGIN) goes down with it.

Where names are alike throughout and the index doesn't tell them apart, pairs of blocks remain that grow as the square of the input; their bits are compared some
hundred million a second and core. Pairs with a segment in common grow as the square too, but are a few thousandths of all at most where names are unlike."""

from __future__ import annotations

import difflib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, ship

ACCEPT = 0.82
MARGIN = 0.05
#: Least ratios, and the lengths of the grams that long texts must share. Any falling ratios do that end with the last; more of them mean more jobs of fewer pairs.
LEVELS = ((0.95, 3), (0.90, 3), (0.85, 2), (ACCEPT - MARGIN, 2))
#: Of an index of rarest grams (tokens): so many common ones are asked for, and they are ordered by how often those of the same remainder occur.
COMMON = 3
REMAINDERS = 1 << 16
#: Texts of a block, and characters that end one before.
BLOCK = 4096
BLOCK_CHARACTERS = 1 << 19
#: Texts of a group within a block.
GROUP = 64
#: Words of a signature: characters seen first, second, third and more often in a text.
WORDS = 4
#: File blocks, and claim blocks, that a task of the unscoped search holds.
HELD = 64
CLAIMED = 32
#: Of the index of segments: it is asked where more pairs than SMALL are in reach and texts have at most LONGEST characters; a pair that it gives, and a look into it,
#: cost as much as the bits of so many pairs; looks made together cost CALL more.
SMALL = 1 << 24
LONGEST = 256
DEAR = 8
LOOK = 20
CALL = 1000
#: Folders of more files are searched like the whole inventory, by many tasks each.
LARGE = 1 << 17
#: From so many characters on difflib takes frequent ones for junk.
JUNK = 200
#: Claims, and pairs, looked at in one go.
CHUNK = 64
PAIRS = 1 << 14
#: Arrow batches end at so many bytes.
BATCH_BYTES = 8 << 20
_EPS = 1e-9


def shared_grams(total: float, ratio: float, q: int) -> float:
    """Grams that two texts of so many characters together share at least."""
    return total * (ratio / 2 - (q - 1) * (1 - ratio)) - (q - 1)


def _grams(text: str, q: int) -> list[int]:
    """Each gram's hash (32 bits, signed), with the number of the same before it. Hashes of up to four bytes differ where the grams do."""
    seen: Counter[str] = Counter()
    out = []
    for i in range(len(text) - q + 1):
        g = text[i : i + q]
        h = zlib.crc32(f"{chr(seen[g])}{g}".encode("utf-8", "surrogatepass"))
        out.append(h - (h >> 31 << 32))
        seen[g] += 1
    return out


def tokens(text: str, ratio: float, q: int, often: np.ndarray) -> list[int]:
    """What a text meets others on: its rarest grams, and its single characters if it may be so short that it shares no gram."""
    least = shared_grams(len(text) + math.ceil(len(text) * ratio / (2 - ratio) - _EPS), ratio, q)
    grams = sorted(_grams(text, q), key=lambda g: (often[g % REMAINDERS], g))
    keep = grams[: max(0, len(grams) - max(math.ceil(least - _EPS), 1) + COMMON)]
    return keep + (_grams(text, 1) if least <= _EPS else [])


def _slots(codes: np.ndarray) -> np.ndarray:
    """The bit of each character (code point): letters and digits of ASCII have their own."""
    letter, digit = (codes >= 97) & (codes < 123), (codes >= 48) & (codes < 58)
    return np.select([letter, digit, codes < 128], [codes - 97, codes - 22, 36 + codes % 28], codes % 64).astype(np.uint64)


def signatures(texts: list[str]) -> np.ndarray:
    """WORDS rows of 64 bits a text: one for each of its characters, by the number of the same before it."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    at = np.repeat(np.arange(len(texts)), lens)
    order = np.lexsort((codes, at))
    codes, at = codes[order], at[order]
    start = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (at[1:] != at[:-1])]) if len(codes) else np.zeros(0, np.int64)
    seen = np.arange(len(codes)) - np.repeat(start, np.diff(np.r_[start, len(codes)]))
    bit = (_slots(codes) + 5 * np.maximum(seen - WORDS + 1, 0).astype(np.uint64)) % np.uint64(64)
    out = np.zeros((WORDS, len(texts)), np.uint64)
    np.bitwise_or.at(out, (np.minimum(seen, WORDS - 1), at), np.uint64(1) << bit)
    return out


def _blocks(texts: DataFrame, name: str) -> DataFrame:
    """id, scope, lo, hi (lengths), least, any_, all_ (bits) and data of blocks of texts (scope, name, key, least) as they come; a block has one scope."""

    def block(number: int, scope: str | None, held: list[tuple]) -> dict:
        keys = [h[1] for h in held]
        bits, lens, least = signatures(keys), [len(k) for k in keys], [h[2] for h in held]
        batch = pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.string()), pa.array(keys, pa.string()), pa.array(least, pa.float64()), *map(pa.array, bits)], names=["name", "key", "least", *[f"w{i}" for i in range(WORDS)]])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        whole = [x.view(np.int64).tolist() for x in (np.bitwise_or.reduce(bits, 1), np.bitwise_and.reduce(bits, 1))]
        return {"id": TaskContext.get().partitionId() << 32 | number, "scope": scope, "lo": min(lens), "hi": max(lens), "least": min(least), "any_": whole[0], "all_": whole[1], "data": sink.getvalue().to_pybytes()}

    schema = pa.schema([("id", pa.int64()), ("scope", pa.string()), ("lo", pa.int32()), ("hi", pa.int32()), ("least", pa.float64()), ("any_", pa.list_(pa.int64())), ("all_", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, scope, size, number = [], None, 0, 0
        for b in batches:
            for s, *row in zip(*(b.column(c).to_pylist() for c in ("scope", name, "key", "least")), strict=True):
                if held and (s != scope or len(held) == BLOCK or size > BLOCK_CHARACTERS):
                    yield pa.RecordBatch.from_pylist([block(number, scope, held)], schema)
                    held, size, number = [], 0, number + 1
                held.append(row)
                scope, size = s, size + len(row[1])
        if held:
            yield pa.RecordBatch.from_pylist([block(number, scope, held)], schema)

    return texts.select("scope", name, "key", "least").mapInArrow(run, "id long, scope string, lo int, hi int, least double, any_ array<long>, all_ array<long>, data binary")


#: By scope, length and letters, so that texts of a block have much in common.
_ORDER = ("scope", "_length", "_letters", "key")


def _ordered(texts: DataFrame) -> DataFrame:
    """With the columns of _ORDER: a sort would take expressions anew for each comparison."""
    return texts.withColumns({"_length": F.length("key"), "_letters": F.array_join(F.sort_array(F.split(F.regexp_replace("key", "[0-9]", ""), "")), "")})


def _parts(texts: DataFrame, rows: int | None = None) -> int:
    """Parts of a table whose work is much for its size: few of few rows, of eight blocks each at most."""
    spark = texts.sparkSession
    usual = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return usual if rows is None else max(1, min(usual, -(-rows // 256)), -(-rows // (8 * BLOCK)))


def _packed(texts: DataFrame, name: str, parts: int | None) -> DataFrame:
    """Blocks of texts: sorted over parts, or, where that is None, with all of a scope together."""
    dealt = _ordered(texts.repartition(_parts(texts), "scope")) if parts is None else _ordered(texts).repartitionByRange(parts, *_ORDER)
    return _blocks(dealt.sortWithinPartitions(*_ORDER), name).checkpoint()


def longest(n_lo, n_hi, m_lo, m_hi, x, y, clip):
    """The lengths n and m in given ranges at which texts of which x and y characters have no counterpart reach the greatest ratio, 2 * min(n - x, m - y) / (n + m)."""
    n = clip(m_hi - y + x, n_lo, n_hi)
    m = clip(n - x + y, m_lo, m_hi)
    return n, m


def _meet(a: DataFrame, b: DataFrame) -> Column:
    """Whether a text of block a and one of block b may reach what one of a's needs."""

    def missing(these: str, those: str) -> Column:
        return sum((F.bit_count(F.get(these, F.lit(w)).bitwiseAND(F.bitwise_not(F.get(those, F.lit(w))))) for w in range(WORDS)), F.lit(0))

    x, y = missing("a.all_", "b.any_"), missing("b.all_", "a.any_")
    n, m = longest(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi"), x, y, lambda v, lo, hi: F.least(F.greatest(v, lo), hi))
    return 2 * F.least(n - x, m - y) >= (F.col("a.least") - _EPS) * (n + m)


class _Texts:
    """A block's columns, padded to whole groups."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch, self.n = batch, batch.num_rows
        self.least = batch.column("least").to_numpy(zero_copy_only=False)
        padded = -(-self.n // GROUP) * GROUP
        self.bits = np.zeros((WORDS, padded), np.uint64)
        for w in range(WORDS):
            self.bits[w, : self.n] = batch.column(f"w{w}").to_numpy()
        self.count = np.bitwise_count(self.bits).sum(0, dtype=np.int32)
        self._keys: list[str] | None = None
        self.lens = np.zeros(padded, np.int32)
        self.lens[: self.n] = pc.utf8_length(batch.column("key")).to_numpy()

    def spare(self) -> np.ndarray:
        """Characters without a bit of their own."""
        return (self.lens - self.count)[: self.n].astype(np.uint32)

    @property
    def keys(self) -> list[str]:
        if self._keys is None:
            self._keys = self.batch.column("key").to_pylist()
        return self._keys

    def groups(self) -> tuple[np.ndarray, ...]:
        """any, all, shortest and longest of each group."""
        bits, lens = self.bits.reshape(WORDS, -1, GROUP), self.lens.reshape(-1, GROUP)
        there = lens > 0
        every = np.bitwise_and.reduce(np.where(there, bits, ~np.uint64(0)), 2)
        return np.bitwise_or.reduce(bits, 2), every, np.where(there, lens, 1 << 30).min(1), lens.max(1)

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """All characters in a row, and where each text begins."""
        return np.frombuffer("".join(self.keys).encode("utf-32-le", "surrogatepass"), "<u4"), np.r_[0, np.cumsum(self.lens[: self.n])]


def common(masks: np.ndarray, ia: np.ndarray, n: np.ndarray, codes: np.ndarray, start: np.ndarray, jb: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs: masks has for each of a's texts (n <= 64 characters) and each code its places as bits."""
    rows = np.full(len(ia), ~np.uint64(0))
    begin = start[jb]
    for i in range(int(m.max(initial=0))):
        code = np.where(i < m, codes[np.minimum(begin + i, len(codes) - 1)], 0)
        met = rows & masks[ia, code]
        rows = (rows + met) | (rows - met)
    inside = ~np.uint64(0) >> (np.uint64(64) - n.astype(np.uint64))
    return np.bitwise_count(~rows & inside).astype(np.int32)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _columns(codes: np.ndarray, start: np.ndarray, of: np.ndarray, length: int) -> np.ndarray:
    """A row for each place of texts of one length, a column for each text."""
    return np.stack([codes[start[of] + p] for p in range(length)]).astype(np.uint64)


def _hashed(columns: np.ndarray) -> np.ndarray:
    """A number for each text's piece; equal pieces have equal ones."""
    out = np.zeros(columns.shape[1], np.uint64)
    for c in columns:
        out = (out ^ c) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _shifts(k: int, errors: int, more: int) -> list[int]:
    """How far the path's segment k (from 0) may lie behind its place in a claim that has more characters more, if k of the errors come before it: each moves it by one."""
    return [v for v in range(-k, k + 1, 2) if abs(more - v) <= errors - k]


class _Shelf:
    """Blocks of paths of one scope, and the index of their segments."""

    def __init__(self, data: bytes) -> None:
        self.batches = list(pa.ipc.open_stream(data))
        self.all = _Texts(pa.Table.from_batches(self.batches).combine_chunks().to_batches()[0])
        self.sizes = np.array([b.num_rows for b in self.batches])
        starts, bits, lens = np.cumsum(self.sizes) - self.sizes, self.all.bits[:, : self.all.n], self.all.lens[: self.all.n]
        self.heads = np.bitwise_or.reduceat(bits, starts, 1), np.bitwise_and.reduceat(bits, starts, 1), np.minimum.reduceat(lens, starts), np.maximum.reduceat(lens, starts)
        self.facing, self.spare = np.ascontiguousarray(bits.T), self.all.spare()
        self.codes, self.start = self.all.codes()
        order = np.argsort(lens, kind="stable")
        known, first = np.unique(lens[order], return_index=True)
        self.lengths = {int(m): part for m, part in zip(known, np.split(order, first[1:]), strict=True) if m}
        self._blocks: dict[int, _Texts] = {}
        self._places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._cut: dict[tuple[int, int, int], tuple[float, list[int]] | None] = {}
        self._begins: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def block(self, number: int) -> _Texts:
        if number not in self._blocks:
            self._blocks[number] = _Texts(self.batches[number])
        return self._blocks[number]

    def _length(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the paths of m characters, and bits that tell two of them apart by their first 0, 1, ... characters (places taken one by one)."""
        if m not in self._places:
            columns = _columns(self.codes, self.start, self.lengths[m], m)
            same = [np.square(np.bincount((c % np.uint64(1021)).astype(np.int64)) / len(c)).sum() for c in columns]
            self._places[m] = columns.astype(np.uint32), np.r_[0.0, np.cumsum(-np.log2(same))]
        return self._places[m]

    def cuts(self, m: int, errors: int, more: int) -> tuple[float, list[int]] | None:
        """Where paths of m characters are cut into segments for claims of more characters more, and how many of these paths a claim is likely to meet then."""
        at = m, errors, more
        if at not in self._cut:
            self._cut[at] = None
            if errors < m <= LONGEST:
                bits = self._length(m)[1]
                alike = np.where(np.tri(m + 1, dtype=bool), np.inf, np.exp2(np.minimum(bits[:, None] - bits, 0)))
                cost, back = np.where(np.arange(m + 1), np.inf, 0.0), []
                for k in range(errors + 1):
                    every = cost[:, None] + max(len(_shifts(k, errors, more)), 1e-3) * alike
                    back.append(every.argmin(0))
                    cost = every.min(0)
                ends = [m]
                for b in back[::-1]:
                    ends.append(int(b[ends[-1]]))
                self._cut[at] = float(cost[m]) * len(self.lengths[m]), ends[::-1]
        return self._cut[at]

    def segments(self, m: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the paths of m characters whose segment has a hash of 0, 1, ... begin, and these paths' numbers. Hashes are cut to as many bits as the paths' count has:
        unlike segments that fall together only add pairs."""
        at = m, begin, end
        if at not in self._begins:
            bits = len(self.lengths[m]).bit_length()
            hashes = _hashed(self._length(m)[0][begin:end].astype(np.uint64)) >> np.uint64(64 - bits)
            begins = np.r_[0, np.cumsum(np.bincount(hashes.astype(np.int64), minlength=1 << bits))]
            self._begins[at] = begins.astype(np.int32), self.lengths[m][np.argsort(hashes)].astype(np.int32)
        return self._begins[at]


def matched(a: str, b: str) -> int:
    """Characters in difflib's matching blocks of two texts, of which b is too short for characters to be taken for junk: the longest block, of these the first in a
    and then in b, then the same before and after it."""
    total, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a_lo, a_hi, b_lo, b_hi = open_.pop()
        low, high, at, to, size = 1, min(a_hi - a_lo, b_hi - b_lo), 0, 0, 0
        while low <= high:
            k = (low + high + 1) // 2
            for i in range(a_lo, a_hi - k + 1):
                j = b.find(a[i : i + k], b_lo, b_hi)
                if j >= 0:
                    while i + k < a_hi and j + k < b_hi and a[i + k] == b[j + k]:
                        k += 1
                    at, to, size, low = i, j, k, k + 1
                    break
            else:
                high = k - 1
        if size:
            total += size
            open_ += (a_lo, at, b_lo, to), (at + size, a_hi, to + size, b_hi)
    return total


class _Claims:
    """The claims of a block and the two best of each so far."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.texts = _Texts(batch)
        self._seen: set[tuple[int, int]] = set()
        self.floor = self.texts.least - _EPS  # what a bound must be above to change an outcome
        self.best: dict[int, list[tuple[float, str]]] = {}
        self._masks: tuple | None = None

    def masks(self) -> tuple[np.ndarray, np.ndarray]:
        """The codes in these claims, and each claim's places of each of them (0: of none); only claims of up to 64 characters have any."""
        if self._masks is None:
            codes, start = self.texts.codes()
            known, dense = np.unique(codes, return_inverse=True)
            lens = self.texts.lens[: self.texts.n]
            at = np.repeat(np.arange(self.texts.n), lens)
            place = np.arange(len(codes)) - start[at]
            out = np.zeros((self.texts.n, len(known) + 1), np.uint64)
            short = lens[at] <= 64
            np.bitwise_or.at(out, (at[short], dense[short] + 1), np.uint64(1) << place[short].astype(np.uint64))
            self._masks = known, out
        return self._masks

    def meet_shelf(self, shelf: _Shelf) -> None:
        """meet() with all blocks of a shelf, or the same by its index."""
        a = self.texts
        (some, every, lo, hi), bits, lens = shelf.heads, a.bits[:, : a.n], a.lens[: a.n]
        x = np.bitwise_count(np.bitwise_and.reduce(bits, 1)[:, None] & ~some).sum(0, dtype=np.int32)
        y = np.bitwise_count(every & ~np.bitwise_or.reduce(bits, 1)[:, None]).sum(0, dtype=np.int32)
        n, m = longest(lens.min(), lens.max(), lo, hi, x, y, np.clip)
        near = np.flatnonzero(2 * np.minimum(n - x, m - y) >= self.floor.min() * (n + m))
        pairs = a.n * int(shelf.sizes[near].sum())
        looks = self._looks(shelf, pairs) if pairs > SMALL else None
        if looks is None:
            for number in near:
                self.meet(shelf.block(number))
        else:
            self._seen.clear()
            self._met(shelf, looks)

    def _looks(self, shelf: _Shelf, most: float) -> list[tuple[np.ndarray, ...]] | None:
        """Claims, paths by segment, the first and last of the paths that share one with each of the claims, and how many characters a pair must match; None if that's
        more work than the bits of so many pairs."""
        a, asked = self.texts, []
        lens = a.lens[: a.n]
        for n in np.unique(lens).tolist():
            of = np.flatnonzero(lens == n)
            for m in shelf.lengths:
                errors = ((1 - self.floor[of]) * (n + m) + _EPS).astype(np.int64)
                errors -= (errors ^ (n + m)) & 1  # as many as characters in all, by twos
                for d in np.unique(errors[errors >= abs(n - m)]).tolist():
                    some = of[errors == d]
                    most -= (len(some) + CALL) * LOOK * sum(len(_shifts(k, d, n - m)) for k in range(d + 1))
                    if most < 0 or (cut := shelf.cuts(m, d, n - m)) is None:
                        return None
                    most -= len(some) * DEAR * cut[0]
                    asked.append((n, m, d, some, cut))
        if most < 0:
            return None
        most += DEAR * sum(len(some) * cut[0] for *_, some, cut in asked)  # now what there really is
        out = []
        codes, start = a.codes()
        for n, m, d, some, (_, ends) in asked:
            columns = _columns(codes, start, some, n)
            for k in range(d + 1):
                begin, end = ends[k], ends[k + 1]
                for shift in _shifts(k, d, n - m):
                    if begin + shift < 0 or end + shift > n:
                        continue
                    begins, paths = shelf.segments(m, begin, end)
                    mine = (_hashed(columns[begin + shift : end + shift]) >> np.uint64(64 - len(shelf.lengths[m]).bit_length())).astype(np.int64)
                    first, last = begins[mine], begins[mine + 1]
                    hit = last > first
                    most -= DEAR * int((last - first).sum())
                    if most < 0:
                        return None
                    out.append((some[hit], paths, first[hit], last[hit], (n + m - d) // 2))
        return out

    def _met(self, shelf: _Shelf, looks: list[tuple[np.ndarray, ...]]) -> None:
        """The ratios that matter among pairs with a segment in common."""
        a, b = self.texts, shelf.all
        n, mine, more = a.lens[: a.n], np.ascontiguousarray(a.bits[:, : a.n].T), a.spare()
        known, masks = self.masks()
        place = np.zeros(int(known.max(initial=0)) + 2, np.int64)
        place[known] = np.arange(len(known)) + 1
        start = np.zeros(b.n, np.int64)
        for some, paths, first, last, least in looks:
            count = last - first
            parts = np.split(np.arange(len(some)), np.flatnonzero(np.diff(np.cumsum(count, dtype=np.int64) // (16 * PAIRS))) + 1) if len(some) else []
            for part in parts:
                i, j = some[part], paths[_ranges(first[part], count[part])]
                bits = np.repeat(mine[i], count[part], 0)
                bits &= shelf.facing.take(j, 0)
                held = (np.bitwise_count(bits).view(np.uint32) * np.uint32(0x01010101) >> np.uint32(24)).ravel()  # the sum of a pair's four bytes
                held += np.minimum(np.repeat(more[i], count[part]), shelf.spare.take(j))
                left = np.flatnonzero(held >= least)
                i, j = np.repeat(i, count[part])[left], j[left]
                ratio = 2.0 * held[left] / (n[i] + b.lens[j])
                left = np.flatnonzero(ratio > self.floor[i])
                for q in range(0, len(left), PAIRS):
                    few = left[q : q + PAIRS]
                    theirs = np.unique(j[few])
                    size = b.lens[theirs].astype(np.int64)
                    codes = place[np.minimum(shelf.codes[_ranges(shelf.start[theirs], size)], len(place) - 1)]
                    start[theirs] = np.cumsum(size) - size
                    self._ratios(i[few], j[few], ratio[few], n, b, codes, start, masks)

    def meet(self, files: _Texts) -> None:
        self._seen.clear()
        a, b = self.texts, files
        n = a.lens[: a.n]
        some, every, lo, hi = b.groups()
        x, y = (np.zeros((a.n, len(lo)), np.int32) for _ in range(2))
        for w in range(WORDS):
            mine = a.bits[w, : a.n, None]
            x += np.bitwise_count(mine & ~some[w])
            y += np.bitwise_count(every[w] & ~mine)
        nn, mm = longest(n[:, None], n[:, None], lo, hi, x, y, np.clip)
        bound = 2.0 * np.minimum(nn - x, mm - y) / (nn + mm)
        near = bound > self.floor[:, None]
        if not near.any():
            return
        (mine, theirs), at = self._matrices(b), None
        for k in range(0, a.n, CHUNK):
            some = np.flatnonzero(near[k : k + CHUNK].any(1)) + k
            g = np.flatnonzero(near[some].any(0))
            if not len(g):
                continue
            j = (g[:, None] * GROUP + np.arange(GROUP)).ravel()
            i, at_j = np.divmod(np.flatnonzero(mine[some] @ theirs[g].reshape(len(j), -1).T > 0), len(j))
            i, j = some[i], j[at_j]
            there = b.lens[j] > 0
            i, j = i[there], j[there]
            m, held = b.lens[j], sum(np.bitwise_count(a.bits[w][i] & b.bits[w][j]).astype(np.int32) for w in range(WORDS))
            ratio = 2.0 * (held + np.minimum(n[i] - a.count[i], m - b.count[j])) / (n[i] + m)
            order = np.flatnonzero(ratio > self.floor[i])
            if not len(order):
                continue
            if len(order) > PAIRS:
                order = order[np.argsort(-ratio[order], kind="stable")]  # the most promising first
            if at is None:
                codes, start = b.codes()
                known, masks = self.masks()
                found = np.searchsorted(known, codes).clip(max=len(known) - 1)
                at = np.where(known[found] == codes, found + 1, 0), start, masks
            for q in range(0, len(order), PAIRS):
                few = order[q : q + PAIRS]
                self._ratios(i[few], j[few], ratio[few], n, b, *at)

    def _matrices(self, b: _Texts) -> tuple[np.ndarray, np.ndarray]:
        """A row for each claim, and one for each file by groups, whose product is above 0 if their bits leave the pair in reach: bits in common and the claim's
        characters without a bit of their own, less half the floor for each character of both. Bits that all have, or only claims, need no column."""
        a, one = self.texts, np.uint64(1)
        ours, theirs = a.bits[:, : a.n], b.bits[:, : b.n]
        always = np.bitwise_and.reduce(ours, 1) & np.bitwise_and.reduce(theirs, 1)
        some = np.bitwise_or.reduce(ours, 1) & np.bitwise_or.reduce(theirs, 1) & ~always
        word, bit = np.nonzero((some[:, None] >> np.arange(64, dtype=np.uint64)) & one)
        bit = bit[:, None].astype(np.uint64)
        n, half = a.lens[: a.n], self.floor / 2
        slack = int(np.bitwise_count(always).sum()) + n - a.count[: a.n] - half * n + 1e-3
        mine = np.vstack([(ours[word] >> bit) & one, half, slack]).T.astype(np.float32)
        facing = np.vstack([(b.bits[word] >> bit) & one, -b.lens, np.ones(len(b.lens))]).T.astype(np.float32)
        return mine, facing.reshape(-1, GROUP, len(word) + 2)

    def _ratios(self, i: np.ndarray, j: np.ndarray, ratio: np.ndarray, n: np.ndarray, b: _Texts, codes: np.ndarray, start: np.ndarray, masks: np.ndarray) -> None:
        still = ratio > self.floor[i]
        i, j, ratio = i[still], j[still], ratio[still]
        m, short = b.lens[j], n[i] <= 64
        s, t = i[short], j[short]
        ratio[short] = 2.0 * common(masks, s, n[s], codes, start, t, m[short]) / (n[s] + m[short])
        still = np.flatnonzero(ratio > self.floor[i])
        mine, theirs = self.texts.keys, b.keys
        matcher = difflib.SequenceMatcher()
        for k in still[np.lexsort((j[still], -ratio[still], i[still]))]:
            at, to = int(i[k]), int(j[k])
            if ratio[k] <= self.floor[at] or (at, to) in self._seen:
                continue
            self._seen.add((at, to))
            # the claim comes first: the ratio isn't symmetric
            if n[at] > 64 or len(theirs[to]) >= JUNK:
                matcher.set_seqs(mine[at], theirs[to])
                if n[at] > 64 and matcher.quick_ratio() <= self.floor[at]:
                    continue
                score = matcher.ratio()
            else:
                score = 2.0 * matched(mine[at], theirs[to]) / (len(mine[at]) + len(theirs[to]))
            if score <= self.floor[at]:
                continue
            best = self.best[at] = sorted([*self.best.get(at, ()), (score, b.batch.column("name")[to].as_py())], reverse=True)[:2]
            if len(best) > 1:  # then only what changes the best or the doubt about it; an equal one doesn't
                self.floor[at] = max(self.floor[at], best[0][0] if best[0][0] - best[1][0] < MARGIN else best[1][0])

    def rows(self) -> list[tuple[str, float, str]]:
        names = self.texts.batch.column("name")
        return [(names[i].as_py(), score, path) for i, two in self.best.items() for score, path in two]


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two best of each claim of pairs of blocks (id, scope, a, b); those with the same claims come together."""
    held, scope, claims = None, None, None

    def out() -> pa.RecordBatch:
        rel, score, path = zip(*rows, strict=True) if (rows := claims.rows()) else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(rel, pa.string()), pa.array([scope] * len(rel), pa.string()), pa.array(score, pa.float64()), pa.array(path, pa.string())], names=["rel", "scope", "score", "path"])

    for batch in batches:
        for number, at, a, b in zip(batch.column("id").to_pylist(), batch.column("scope").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
            if number != held:
                if claims is not None:
                    yield out()
                held, scope, claims = number, at, _Claims(*pa.ipc.open_stream(a.as_buffer()))
            claims.meet(_Texts(*pa.ipc.open_stream(b.as_buffer())))
    if claims is not None:
        yield out()


def _bundled(blocks: DataFrame, parts: int) -> DataFrame:
    """scope and data of the blocks of a part together, a row for each scope."""

    def bundle(scope: str | None, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema) as out:
            for b in held:
                out.write_batch(b)
        return pa.RecordBatch.from_arrays([pa.array([scope], pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["scope", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, scope = [], None
        for batch in batches:
            for at, data in zip(batch.column("scope").to_pylist(), batch.column("data"), strict=True):
                if held and (at != scope or len(held) == HELD):
                    yield bundle(scope, held)
                    held = []
                held, scope = [*held, *pa.ipc.open_stream(data.as_py())], at
        if held:
            yield bundle(scope, held)

    return blocks.coalesce(max(1, parts)).select("scope", "data").mapInArrow(run, "scope string, data binary")


def _top_of_shelves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two best of each claim of pairs of bundles (scope, a, b)."""
    for batch in batches:
        for scope, a, b in zip(batch.column("scope").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
            shelf = _Shelf(b.as_buffer())
            for held in pa.ipc.open_stream(a.as_buffer()):
                claims = _Claims(held)
                claims.meet_shelf(shelf)
                if rows := claims.rows():
                    rel, score, path = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(rel, pa.string()), pa.array([scope] * len(rel), pa.string()), pa.array(score, pa.float64()), pa.array(path, pa.string())], names=["rel", "scope", "score", "path"])


def _best(top: DataFrame) -> DataFrame:
    """rel, scope, best, path and second (the next ratio) of claims by the best that each task found (rel, scope, score, path)."""
    two = top.groupBy("rel", "scope").agg(F.sort_array(F.collect_list(F.struct("score", "path")), asc=False).alias("t"))  # two for each task that had the claim
    return two.select("rel", "scope", F.get("t", F.lit(0))["score"].alias("best"), F.get("t", F.lit(0))["path"].alias("path"), F.get("t", F.lit(1))["score"].alias("second"))


def _within_reach(open_: DataFrame, blocks: DataFrame) -> DataFrame:
    """open_ (rel, scope, key, least) without claims whose whole block has no block of paths in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scope, data in zip(batch.column("scope").to_pylist(), batch.column("data"), strict=True):
                held = pa.ipc.open_stream(data.as_buffer()).read_next_batch()
                yield pa.RecordBatch.from_arrays([held.column("name"), pa.array([scope] * held.num_rows, pa.string()), held.column("key"), held.column("least")], names=["rel", "scope", "key", "least"])

    heads = blocks.drop("data").alias("b")  # a row for BLOCK paths
    a = _packed(open_, "rel", _parts(open_, open_.count())).alias("a")
    near = a.join(F.broadcast(heads), F.col("a.scope").eqNullSafe(F.col("b.scope")) & _meet(a, heads), "left_semi")
    return near.select("scope", "data").mapInArrow(run, "rel string, scope string, key string, least double")


def _searched(open_: DataFrame, blocks: DataFrame, scoped: bool) -> DataFrame:
    """open_ (rel, scope, key, least) with best, path and second of those that have a path of the ratio least."""
    schema = "rel string, scope string, score double, path string"
    if scoped:
        a, b = _packed(open_, "rel", None).alias("a"), blocks.alias("b")
        met = a.join(b, (F.col("a.scope") == F.col("b.scope")) & _meet(a, b))
        top = met.select("a.id", "a.scope", F.col("a.data").alias("a"), F.col("b.data").alias("b")).mapInArrow(_top, schema)
    else:
        rows, shelves = open_.count(), max(1, -(-blocks.count() // HELD))
        parts = max(-(-3 * open_.sparkSession.sparkContext.defaultParallelism // shelves), -(-rows // (CLAIMED * BLOCK)))
        a = _bundled(_packed(open_, "rel", _parts(open_, rows)), parts).alias("a")
        b = _bundled(blocks, shelves).alias("b")
        met = a.hint("shuffle_replicate_nl").join(b, F.col("a.scope").eqNullSafe(F.col("b.scope")))
        top = met.select("a.scope", F.col("a.data").alias("a"), F.col("b.data").alias("b")).mapInArrow(_top_of_shelves, schema)
    two = _best(top).withColumnsRenamed({"rel": "_rel", "scope": "_scope"})
    return open_.join(two, (F.col("rel") == F.col("_rel")) & F.col("scope").eqNullSafe(F.col("_scope")), "left").drop("_rel", "_scope")


def _decided(found: DataFrame) -> DataFrame:
    clear = (F.col("best") >= ACCEPT) & (F.col("best") - F.coalesce("second", F.lit(0.0)) >= MARGIN)
    return found.select("rel", "scope", F.when(clear, F.col("path")).alias("fuzzy_path"), "best", ((F.col("best") >= ACCEPT) & ~clear).alias("ambiguous"))


def most_similar(claims: DataFrame, files: DataFrame, together: bool = False) -> DataFrame:
    """rel, scope, fuzzy_path, best, ambiguous of claims (rel, scope, key) that have a path of ratio ACCEPT - MARGIN or more: fuzzy_path if its ratio is ACCEPT or
    more and no other's within MARGIN of it. files: scope, path, key; a claim meets the files of its scope (NULL meets NULL). together: scopes are of moderate size,
    so that each may be one task's work."""
    spark = claims.sparkSession
    ship(spark)
    shared_folder(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    files = files.select("scope", "path", "key", F.lit(0.0).alias("least"))
    blocks = _packed(files, "path", None if together else _parts(files, files.count()))
    if not together:
        blocks = blocks.coalesce(max(1, -(-blocks.count() // HELD)))
    open_, done = claims.select("rel", "scope", "key", F.lit(LEVELS[-1][0]).alias("least")).checkpoint(), []
    if not together:
        open_ = _within_reach(open_, blocks).checkpoint()
    open_ = open_.withColumn("least", F.lit(LEVELS[0][0]))
    for (ratio, _), (lower, _) in zip(LEVELS, [*LEVELS[1:], (None, 0)], strict=True):
        if open_.isEmpty():
            break
        found = _searched(open_, blocks, together).checkpoint()
        close = F.coalesce(F.col("second") > F.col("best") - MARGIN, F.lit(False))
        settled = F.col("best").isNotNull() & F.coalesce(F.lit(lower is None) | close | (F.col("best") - MARGIN >= ratio), F.lit(False))
        done.append(found.where(settled))
        if lower is None:
            break
        open_ = found.where(~settled).select("rel", "scope", "key", F.greatest(F.lit(lower), F.col("best") - MARGIN).alias("least"))
    every = done[0] if done else open_.withColumns({"best": F.lit(None).cast("double"), "path": F.lit(None).cast("string"), "second": F.lit(None).cast("double")})
    for d in done[1:]:
        every = every.unionByName(d)
    return _decided(every)
