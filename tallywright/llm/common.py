"""Shared helpers: reading, checkpoints, crc folds and vectorised word hashing over Arrow buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D; ASCII capitals count as small letters.
Hashes are 64-bit polynomials over a table of random byte values, finished by a bit mixer, so one numpy
pass hashes every word of a batch without making Python strings.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship

U64 = np.uint64
PIECE = 1 << 19
#: Shingles of this many words stand for a text in near-duplicate operators.
SHINGLE = 5

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = (int(_rng.integers(1, 2**61)) * 8 + 5) % 2**64
_INVERSE = pow(_BASE, -1, 2**64)
WORD_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


#: Texts go to Python workers in batches of so many bytes at most, or one by one where a text is longer.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the session then bounds its Arrow batches by bytes, which holds down both the JVM's and the workers' memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts df's lineage: writes it as Parquet to the shared checkpoint folder and reads it back.

    Against checkpoint() that halves the disk, and the table's size is known again: a checkpoint keeps the size that was
    estimated for its plan, and estimates of joins multiply from round to round until planning takes all time and memory."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


_scratch: list[list[str]] = []
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Tables that cut() writes in this block are deleted at its end, but for those given to the function that the block gets:
    keep(result, table, ...) gives back the result and spares the tables that it still reads (the result itself, if none are named)."""
    paths, kept = [], []

    def keep(result: DataFrame, *tables: DataFrame) -> DataFrame:
        kept.extend(_written[t] for t in tables or (result,))
        return result

    _scratch.append(paths)
    try:
        yield keep
    finally:
        _scratch.pop()
        for path in set(paths) - set(kept):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if _scratch:
            _scratch[-1].extend(kept)


def tidy(spark: SparkSession) -> None:
    """Between the rounds of an iterative job: what earlier rounds left is collected, so that Spark removes their shuffle files,
    broadcasts and checkpoints, and the driver gives memory back. Otherwise they stay until the driver happens to collect its garbage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow, after which a worker gives back what Arrow's pool holds: workers live on and serve the next stages."""

    def tidily(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(tidily, schema)


#: Keys of more than one SPREADth of all rows are dealt over salts; there are fewer than SPREAD of them.
SPREAD = 1000


def dealt(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with keyed, which has each key once, with its rows' number as weight. total: the sum of the weights.

    A key that has more than a SPREADth of all rows is dealt over as many salts as it has SPREADths, so that no task gets a hot key whole.
    keyed should be a written table, its keys short: the hot ones (fewer than SPREAD) are broadcast."""
    most = max(total / SPREAD, 1)
    hot = F.broadcast(keyed.where(F.col("weight") > most).select(key, F.ceil(F.col("weight") / most).cast("int").alias("_salts")))
    left = rows.withColumn("_row", F.monotonically_increasing_id()).join(hot, key, "left").withColumn("_salt", F.pmod("_row", F.coalesce("_salts", F.lit(1))).cast("int"))
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("weight") > most, F.ceil(F.col("weight") / most).cast("int")).otherwise(1) - 1)))
    return left.join(right, [key, "_salt"]).drop("_row", "_salt", "_salts")


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; a null id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    out = np.ones(max(n, 1), U64)
    if n > 1:
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE * 2 + 1, n)
    if size not in _tables:
        _tables.clear()
        _tables[size] = powers(size, _BASE), powers(size, _INVERSE)
    return _tables[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher in place; h: fresh uint64 array."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA3AAACCB94D4B1F5)
    h ^= h >> U64(32)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offs[0] : offs[-1]], offs - offs[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ascending, non-overlapping span of bytes, piece by piece so that scratch space stays bounded."""
    out = np.zeros(len(starts), U64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + PIECE, side="right"))
        if j <= i:  # one span longer than a piece
            out[i] = xxhash.xxh64_intdigest(data[at : int(ends[i])].tobytes())
            i += 1
            continue
        till = int(ends[j - 1])
        power, inverse = power_tables(0)
        sums = np.zeros(till - at + 1, U64)
        np.cumsum(BYTE_VALUE[data[at:till]] * power[: till - at], out=sums[1:])
        a = starts[i:j] - at
        h = (sums[ends[i:j] - at] - sums[a]) * inverse[a]
        long = ends[i:j] - starts[i:j] > PIECE
        out[i:j] = mix(h + (ends[i:j] - starts[i:j]).astype(U64))
        assert not long.any()
        i = j
    return out


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends (bytes), hashes of all words, and first: words of text i are first[i]:first[i+1]."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64), np.zeros(len(offs), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    del word, edge, begin, end
    return starts, ends, span_hashes(LOWER[data], starts, ends), np.searchsorted(starts, offs)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles in text order, and first as in words(). A text of 1 to k-1 words is one shingle."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(at[-1]), U64)
    full = len(hashes) - k + 1
    if full > 0:
        rolled = np.zeros(full, U64)
        for j in range(k):
            rolled += hashes[j : j + full] * WORD_MIX[j]
        inside = np.ones(full, bool)
        for j in range(1, k):  # a shingle mustn't run into the next text
            cutoff = first[1:-1] - j
            inside[cutoff[(cutoff >= 0) & (cutoff < full)]] = False
        long = np.repeat(n >= k, count)
        out[long] = rolled[inside & np.repeat(n >= k, n)[:full]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        out[at[i]] = (hashes[first[i] : first[i + 1]] * WORD_MIX[: n[i]]).sum(dtype=U64) ^ WORD_MIX[40 + n[i]]
    return mix(out), at
