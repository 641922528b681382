"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, mix.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the columns of docs.
The last gives each kept document's places in the mixed stream. No SQL can express the learned and hashed stages, so
there is no ORACLE_SQL; tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywright.llm import decontaminate, mixing, neardup, quality, suffixes
from tallywright.llm.common import cut, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that score at or above the quality threshold; the classifier learns from the labelled rows of docs."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of least id, of each class of near-duplicates."""
    return neardup.deduplicated(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out all but the first occurrence of each passage of 50 words or more; a text of which nothing is left goes."""
    return suffixes.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, block, epoch, slot, offset of each kept document in the mix of sources."""
    return mixing.place(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", neardup_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage wrote on its way goes when its result is written
            docs = keep(cut(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
