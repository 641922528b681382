"""Change-journal events (file_name, reason_mask, reasons, timestamp_utc, usn) and raid windows over inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reasons, timeutil


def decode(events: DataFrame) -> DataFrame:
    """events (reason_mask) with the names of its reasons."""
    return events.withColumn("reasons", reasons.names(F.col("reason_mask")))


def select(events: DataFrame, since: str | None = None, name_contains: str | None = None) -> DataFrame:
    """since: ISO text; events without a time are dropped only if it is given."""
    if since is not None:
        events = events.where(F.col("timestamp_utc") >= since)
    if name_contains:
        events = events.where(F.lower("file_name").contains(name_contains.lower()))
    return events


def histogram(events: DataFrame) -> DataFrame:
    return events.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("events"))


def notable(events: DataFrame) -> DataFrame:
    return events.where(F.arrays_overlap("reasons", F.array(*map(F.lit, reasons.NOTABLE))))


def deletions(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Deleted or renamed-away names within the window."""
    gone = F.exists("reasons", lambda r: r.contains("delete") | (r == "rename_old"))
    out = events.where(gone)
    if since is not None:
        out = out.where(F.col("timestamp_utc") >= since)
    if until is not None:
        out = out.where(F.col("timestamp_utc") <= until)
    return out


def window(files: DataFrame, since_ns: int, until_ns: int, birth: str = "ctime_ns") -> DataFrame:
    """Files touched within [since, until]: created, modified, accessed_only (read but not changed), first_seen. Links are left out."""
    inside = lambda c: F.coalesce(F.col(c).between(since_ns, until_ns), F.lit(False))
    flags = files.where("kind <> 'symlink'").withColumns({"created": inside(birth), "modified": inside("mtime_ns"), "accessed_only": inside("atime_ns") & ~inside("mtime_ns")})
    hit = flags.where("created OR modified OR accessed_only")
    return hit.withColumn("first_seen", timeutil.ns_to_iso(F.when(F.col("created"), F.col(birth)).otherwise(F.col("mtime_ns"))))


def window_order(hits: DataFrame) -> DataFrame:
    """Hits by the time that brought them in, then by path."""
    return hits.orderBy("first_seen", "path")


def window_summary(hits: DataFrame, files: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """One row: files, created, modified, accessed_only, truncated; with files also how many were looked at and how many couldn't be read.

    truncated: more than most hits, where a report is to list so many only; no hit is dropped."""
    out = hits.agg(F.count("*").alias("files"), *[F.count_if(c).alias(c) for c in ("created", "modified", "accessed_only")]).withColumn("truncated", F.lit(False) if most is None else F.col("files") > most)
    if files is None:
        return out
    return out.crossJoin(files.where("kind NOT IN ('dir', 'symlink')").agg(F.count("*").alias("entries_scanned"), F.count_if(F.col("status").isin("stat_error", "read_error")).alias("read_errors")))


def timeline(*parts: tuple[str, DataFrame, Column, Column]) -> DataFrame:
    """ts, source, description from (source, frame, time, text) parts."""
    out = None
    for name, df, ts, text in parts:
        one = df.select(ts.alias("ts"), F.lit(name).alias("source"), text.alias("description"))
        out = one if out is None else out.unionByName(one)
    return out
