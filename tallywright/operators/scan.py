"""Scan of an inventory by scope criteria: numbered hits and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..plans.criteria import Profile, evaluate
from ..schema import VERDICTS
from ..sources.parsers import TEXT_TYPES
from .custody import numbered
from .inventory import walk_order


def scan(files: DataFrame, profile: Profile, content: str | None = None, hash_sets: DataFrame | None = None) -> DataFrame:
    """Entries other than folders that fit some criterion, excluded and unverifiable ones left out, with seq in walk order from 1.

    The number is a global one: hits' paths are sorted by range and numbered partition by partition, so no task sorts them all."""
    judged = evaluate(files.where("kind <> 'dir'"), profile, content, hash_sets)
    if content and any(k.where in ("content", "both") for k in profile.keywords):
        tried = (F.col("size") <= 32 << 20) & paths.extension(F.col("path")).isin(*TEXT_TYPES)
        judged = judged.withColumn("status", F.when(tried & F.col(content).isNull(), F.lit("extract_failed")).otherwise(F.col("status")))
    hits = judged.where(F.col("broad") & ~F.col("verdict").isin("excluded", "unverifiable"))
    order = [c.alias(f"_o{i}") for i, c in enumerate(walk_order(F.col("path")))]
    keys = [f"_o{i}" for i in range(len(order))]
    return numbered(hits.select("*", *order, F.lit(1).alias("_all")), ["_all", *keys, "path"], ["_all"]).withColumnRenamed("no", "seq").drop("_all", *keys)


def counters(files: DataFrame, profile: Profile, content: str | None = None, hash_sets: DataFrame | None = None, extractable: int = 32 << 20) -> DataFrame:
    """One row of a scan's counters, and statuses with their numbers.

    content names the column of extracted text, NULL where extraction failed. Content counts only where the profile has content
    keywords: a file is tried if its type is known and it has extractable bytes at most, otherwise it's counted as not evaluated."""
    judged = evaluate(files.where("kind <> 'dir'"), profile, content, hash_sets)
    terms = sum(k.where in ("content", "both") for k in profile.keywords)
    tried = F.coalesce(F.lit(bool(terms)) & (F.col("size") <= extractable) & paths.extension(F.col("path")).isin(*TEXT_TYPES), F.lit(False))
    got = F.col(content).isNotNull() if content else F.lit(False)
    hit = F.coalesce(F.col("broad") & ~F.col("verdict").isin("excluded", "unverifiable"), F.lit(False))
    verdict = F.col("verdict")
    row = judged.agg(
        F.count("*").alias("evaluated"), F.count_if(verdict == "excluded").alias("excluded"), F.count_if(hit).alias("hits"),
        *[F.count_if(hit & (verdict == v)).alias(v) for v in ("in_scope", "in_scope_partial")], F.count_if(hit & ~verdict.isin("in_scope", "in_scope_partial")).alias("borderline"),
        F.count_if(F.col("status").isin("stat_error", "read_error")).alias("errors"), F.count_if(tried & got).alias("content_extracted"), F.count_if(tried & ~got).alias("content_extract_failed"),
        F.count_if(F.lit(bool(terms)) & ~tried).alias("content_not_evaluated"), F.count_if(verdict == "unverifiable").alias("unverifiable"), F.lit(terms).cast("long").alias("content_keyword_terms"),
    )
    statuses = judged.groupBy("status").count().agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("status", F.lit("unknown")), "count"))).alias("statuses"))  # a few names
    return row.crossJoin(statuses)


def summary(judged: DataFrame) -> DataFrame:
    """One row over evaluate()'s result: files, narrow, broad and each verdict, those that don't occur as 0."""
    return judged.agg(F.count("*").alias("files"), F.count_if("narrow").alias("narrow"), F.count_if("broad").alias("broad"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
