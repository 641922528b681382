"""Inventories as tables: reuse of digests between snapshots, counts, and the order in which a walk meets paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reuse_digests(live: DataFrame, previous: DataFrame) -> DataFrame:
    """live with the digest of an unchanged previous record (same size, mtime and kind) and whether it still must be hashed.

    A previous record without a digest is reused only if it was left out for its size."""
    p = previous.select("path", *[F.col(n).alias(f"p_{n}") for n in ("size", "mtime_ns", "kind", "sha256", "status")])
    same = F.col("size").eqNullSafe(F.col("p_size")) & F.col("mtime_ns").eqNullSafe(F.col("p_mtime_ns")) & F.col("kind").eqNullSafe(F.col("p_kind")) & F.col("p_kind").isNotNull()
    usable = same & ((F.col("p_sha256").isNotNull() & (F.col("p_status") == "ok")) | (F.col("p_status") == "hash_skipped_oversize"))
    return live.join(p, "path", "left").select(
        *[c for c in live.columns if c not in ("sha256", "status")],
        F.when(usable, F.col("p_sha256")).alias("sha256"),
        F.when(usable, F.col("p_status")).otherwise(F.col("status")).alias("status"),
        F.coalesce(usable, F.lit(False)).alias("reused"),
        ((F.col("kind") == "file") & ~F.coalesce(usable, F.lit(False))).alias("to_hash"),
    )


def counts(files: DataFrame, by: str = "kind") -> DataFrame:
    return files.groupBy(by).count()


def refreshed(live: DataFrame, previous: DataFrame, digest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """live with its digests up to date: those of unchanged records from previous, the others from digest(), which gets the rows that must be
    hashed and gives them back with sha256 and status. Columns of live and reused. Records of previous that live doesn't have don't come back."""
    plan = reuse_digests(live, previous)
    fresh = digest(plan.where("to_hash").drop("to_hash")).select(*live.columns, F.lit(False).alias("reused"))
    return plan.where("NOT to_hash").select(*live.columns, "reused").unionByName(fresh)


def access_mode(modes: Column) -> Column:
    """Rollup of the set of access-time modes of a run; files that were skipped for their size don't tell more than none."""
    told = F.array_sort(F.array_distinct(F.transform(modes, lambda m: F.when(m == "skipped", F.lit("none")).otherwise(m))))
    both = F.array_remove(told, "none")
    return F.when(F.size(told) == 0, F.lit("n/a")).when(F.size(both) == 0, F.lit("none")).when((F.size(told) == 1), told[0]).otherwise(F.lit("mixed"))


def walk_order(path: Column) -> list[Column]:
    """Sort keys of a walk: entries of a directory by name, all before what its subdirectories hold, which follow in order."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    return [F.transform(parts, lambda x, i: F.struct(F.when(i == depth - 1, F.lit(0)).otherwise(F.lit(1)).alias("inner"), x.alias("name")))]


def meta(files: DataFrame, root: str, created_utc: str, modes: list[str] | None = None) -> DataFrame:
    """key, value (JSON) of an inventory: root, time, number of entries, of each kind and status, how access times were read (modes, or else
    the rows' access_mode) and, if the rows tell, how many digests were reused."""
    def as_json(df: DataFrame, key: str) -> DataFrame:
        pairs = df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(key), F.lit("unknown")), F.col("count"))))).alias("m"))  # a few names
        return pairs.select(F.to_json("m").alias("value"))

    def said(key: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(key).alias("key"), F.regexp_extract(F.to_json(F.array("value")), r"^\[(.*)\]$", 1).alias("value"))

    one = files.sparkSession.range(1)
    if modes is None and "access_mode" in files.columns:
        told = files.agg(F.array_sort(F.collect_set("access_mode")).alias("m"))  # a few names
    else:
        told = one.select(F.array(*map(F.lit, modes or [])).cast("array<string>").alias("m"))
    out = said("root", one.select(F.lit(root).alias("value"))).unionByName(said("created_utc", one.select(F.lit(created_utc).alias("value")))).unionByName(said("access_mode", told.select(access_mode(F.col("m")).alias("value"))))
    out = out.unionByName(files.agg(F.count("*").cast("string").alias("value")).select(F.lit("entries").alias("key"), "value"))
    if "reused" in files.columns:
        out = out.unionByName(files.agg(F.count_if("reused").cast("string").alias("value")).select(F.lit("reused").alias("key"), "value"))
    for key, name in (("kind", "kinds"), ("status", "statuses")):
        out = out.unionByName(as_json(counts(files, key), key).select(F.lit(name).alias("key"), "value"))
    return out
