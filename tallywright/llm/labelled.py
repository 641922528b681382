"""A bounded, documented sample of labelled training texts for the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold

#: At most so many labelled rows of each class are learned from, those with the smallest hash of their id.
ROWS_PER_CLASS = 4000
#: Of these rows so many, in the same order, as have this many bytes of text together; texts are whole, and the first row counts always.
BYTES_PER_CLASS = 32 << 20


def sample(docs: DataFrame, labels: DataFrame, target: str, rows: int = ROWS_PER_CLASS, size: int = BYTES_PER_CLASS) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Whole texts, labels (0/1) and a 32-bit split number of the sampled training rows.

    Rows whose crc32 fold is 0, whose id or label is null, or whose label is neither 0 nor 1 aren't learned from.
    Rows are drawn from the labels table first, so what is broadcast has 2 * rows ids at most.
    """
    wanted = labels.select(F.col("doc_id").alias("_id"), F.col(target).cast("int").alias("_y")).where((fold("_id") != 0) & F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
    wanted = wanted.groupBy("_id").agg(F.max("_y").alias("_y"))
    picked = None
    for y in (0, 1):
        part = wanted.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    so_far = Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, -1)
    held = texts.join(F.broadcast(picked), "_id").withColumn("_before", F.coalesce(F.sum(F.octet_length("_text")).over(so_far), F.lit(0)))
    fits = (F.col("_before") + F.octet_length("_text") <= size) | (F.col("_before") == 0)
    got = held.where(fits).select("_id", "_text", "_y", F.crc32(F.concat(F.lit("split"), F.col("_id").cast("string")).cast("binary")).alias("_s")).toArrow()
    order = np.lexsort((got["_s"].to_numpy(), got["_id"].to_numpy()))
    texts_ = [x.encode() for x in got["_text"].to_pylist()]
    return [texts_[i] for i in order], got["_y"].to_numpy()[order].astype(int), got["_s"].to_numpy()[order]
