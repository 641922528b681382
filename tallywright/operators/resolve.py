"""Resolution of claimed paths against an inventory: exact, unique suffix, then similar text (similar.py), anywhere or below a folder.

Suffix matches are an equality join on exploded suffixes (one row for each directory level). Similar paths are searched for only for claims
that no other tier settles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..session import shared_folder
from .similar import LARGE, most_similar


def exact_and_suffix(items: DataFrame, files: DataFrame) -> DataFrame:
    """items (ord, rel, ...) with matched_path, tier (exact, suffix or NULL) and suffix_hits."""
    known = files.select("path")
    exact = items.join(known.withColumnRenamed("path", "exact_path"), F.col("rel") == F.col("exact_path"), "left")
    tails = known.select("path", F.explode(paths.suffixes(F.col("path"))).alias("tail"))
    wanted = items.select("rel").where("rel IS NOT NULL AND rel <> ''").distinct()
    hits = wanted.join(tails, F.col("rel") == F.col("tail")).groupBy("rel").agg(F.count("*").alias("suffix_hits"), F.min("path").alias("suffix_path"))
    joined = exact.join(hits, "rel", "left")
    unique = F.col("exact_path").isNull() & (F.col("suffix_hits") == 1)
    return joined.select(
        *items.columns,
        F.coalesce("exact_path", F.when(unique, F.col("suffix_path"))).alias("matched_path"),
        F.when(F.col("exact_path").isNotNull(), F.lit("exact")).when(unique, F.lit("suffix")).alias("tier"),
        F.when(F.col("exact_path").isNull(), F.coalesce("suffix_hits", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("suffix_hits"),
    )


def fuzzy(claims: DataFrame, files: DataFrame) -> DataFrame:
    """rel, fuzzy_path, best, ambiguous of each distinct claims.rel that has a candidate of ratio 0.77 or more."""
    asked = claims.select("rel").where("rel IS NOT NULL AND rel <> ''").distinct().select("rel", F.lit(None).cast("string").alias("scope"), paths.fuzzy_key("rel").alias("key"))
    return most_similar(asked, files.select(F.lit(None).cast("string").alias("scope"), "path", paths.fuzzy_key("path").alias("key"))).drop("scope")


def deepest_ancestor(items: DataFrame, directories: DataFrame) -> DataFrame:
    """rel, scope: the deepest directory above each claimed path that exists; NULL if not even the first does."""
    up = items.select("rel").distinct().select("rel", F.explode(paths.ancestors(F.col("rel"))).alias("dir"))
    found = up.join(directories.select(F.col("path").alias("dir")), "dir").groupBy("rel").agg(F.max_by("dir", F.length("dir")).alias("scope"))
    return items.select("rel").distinct().join(found, "rel", "left")


def scoped(items: DataFrame, files: DataFrame, directories: DataFrame) -> DataFrame:
    """rel, path, status of claims (rel): resolved_direct if the path is there, resolved_fuzzy if a similar one lies in the deepest
    directory above it that exists, not_found otherwise. A claim of which no directory exists isn't searched for.

    A folder's files are one task's work, those of a LARGE one many tasks'."""
    shared_folder(items.sparkSession)
    known = files.select(F.col("path").alias("_path"))
    direct = items.select("rel").distinct().join(known, F.col("rel") == F.col("_path"), "left")
    open_ = deepest_ancestor(direct.where("_path IS NULL"), directories).where("scope IS NOT NULL")
    asked = open_.select("rel", "scope", paths.fuzzy_key("rel").alias("key")).checkpoint()
    below = files.select("path", F.explode(paths.ancestors(F.col("path"))).alias("scope")).join(asked.select("scope").distinct(), "scope", "left_semi")
    keyed = below.select("scope", "path", paths.fuzzy_key("path").alias("key")).checkpoint()
    large = keyed.groupBy("scope").count().where(F.col("count") > LARGE).select("scope").checkpoint()
    if large.isEmpty():
        best = most_similar(asked, keyed, together=True)
    else:
        best = most_similar(asked.join(large, "scope", "left_anti"), keyed.join(large, "scope", "left_anti"), together=True)
        best = best.unionByName(most_similar(asked.join(large, "scope", "left_semi"), keyed.join(large, "scope", "left_semi")))
    best = best.drop("scope")
    joined = direct.join(best, "rel", "left")
    status = F.when(F.col("_path").isNotNull(), F.lit("resolved_direct")).when(F.col("fuzzy_path").isNotNull(), F.lit("resolved_fuzzy")).otherwise(F.lit("not_found"))
    return joined.select("rel", F.coalesce("_path", "fuzzy_path").alias("path"), status.alias("status"))
