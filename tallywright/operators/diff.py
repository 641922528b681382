"""Difference of two inventories: one full outer join on the path, then column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CHANGE_CLASSES

BRIEF = ("size", "mtime_ns", "sha256", "kind", "status")


def change_class(b: dict[str, Column], a: dict[str, Column]) -> Column:
    """The class of a path in both inventories; an empty digest counts as missing."""
    has = lambda c: c.isNotNull() & (c != "")
    moved = {n: ~b[n].eqNullSafe(a[n]) for n in ("mtime_ns", "ctime_ns", "atime_ns", "size", "status")}
    hashed = has(b["sha256"]) & has(a["sha256"])
    return (
        F.when(~b["kind"].eqNullSafe(a["kind"]), F.lit("kind_changed"))
        .when(hashed & (b["sha256"] != a["sha256"]), F.lit("content_changed"))
        .when(hashed & moved["atime_ns"] & ~moved["mtime_ns"], F.lit("accessed"))
        .when(hashed & (moved["mtime_ns"] | moved["ctime_ns"] | moved["size"] | moved["atime_ns"]), F.lit("metadata_changed"))
        .when(hashed, F.lit("unchanged"))
        .when(moved["status"], F.lit("status_changed"))
        .when(moved["mtime_ns"] | moved["ctime_ns"] | moved["size"], F.lit("modified_unverifiable"))
        .otherwise(F.lit("unchanged_unverifiable"))
    )


def diff(baseline: DataFrame, current: DataFrame, baseline_created_ns: int | None = None) -> DataFrame:
    """path, change (added, removed, changed, unchanged), class, before, after, backdated of every path in either.

    backdated: an added file whose modification time is before the baseline was made."""
    names = ("path", "size", "mtime_ns", "ctime_ns", "atime_ns", "sha256", "kind", "status")
    b, a = (df.select(*[F.col(n).alias(f"{side}_{n}") for n in names]) for df, side in ((baseline, "b"), (current, "a")))
    both = b.join(a, F.col("b_path") == F.col("a_path"), "full_outer")
    cols = lambda side: {n: F.col(f"{side}_{n}") for n in names}
    kind = F.when(F.col("b_path").isNull(), F.lit("added")).when(F.col("a_path").isNull(), F.lit("removed"))
    cls = F.when(kind.isNull(), change_class(cols("b"), cols("a")))
    brief = lambda side: F.when(F.col(f"{side}_path").isNotNull(), F.struct(*[F.col(f"{side}_{n}").alias(n) for n in BRIEF]))
    created = F.lit(baseline_created_ns).cast("long")
    late = F.col("b_path").isNull() & (F.col("a_kind") == "file") & (F.col("a_mtime_ns") > 0) & (F.col("a_mtime_ns") < created)
    return both.select(
        F.coalesce("b_path", "a_path").alias("path"),
        F.coalesce(kind, F.when(cls.isin("unchanged", "unchanged_unverifiable"), F.lit("unchanged")).otherwise(F.lit("changed"))).alias("change"),
        cls.alias("class"),
        brief("b").alias("before"),
        brief("a").alias("after"),
        F.coalesce(late, F.lit(False)).alias("backdated"),
    )


def summary(changes: DataFrame) -> DataFrame:
    """One row; classes that don't occur count 0."""
    counts = {"added": F.col("change") == "added", "removed": F.col("change") == "removed", "backdated": F.col("backdated")} | {c: F.col("class") == c for c in CHANGE_CLASSES}
    return changes.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
