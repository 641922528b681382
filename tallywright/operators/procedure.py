"""The log of a case's procedure: when each step ended, and over which time a watcher saw what, in one order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .custody import numbered


def steps(manifests: DataFrame) -> DataFrame:
    """ts, description of manifests (path, content): when a command finished, and the manifest's folder and digest. A content that can't be read, or
    lacks a value, shows '?'."""
    told = F.from_json(F.col("content").cast("string"), "finished_utc string, command string")
    known = lambda c: F.coalesce(told[c], F.lit("?"))
    folder = F.element_at(F.split(F.concat(F.lit("/"), "path"), "/"), -2)
    return manifests.select(known("finished_utc").alias("ts"), F.concat(known("command"), F.lit(" finished ("), folder, F.lit("/, manifest "), F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 16), F.lit(")")).alias("description"))


def watches(lines: DataFrame) -> DataFrame:
    """ts, description of event logs (path, ord, value; value one JSON object): each log's first and last time in the order of its lines, whatever they say, and
    how many events of each kind. Lines that aren't objects don't count; one without a time has no part in first and last."""
    told = lines.select("path", "ord", F.from_json("value", "event string, ts string, ts_utc string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("e")).where("e IS NOT NULL AND e._bad IS NULL")
    ts = F.nullif(F.coalesce("e.ts", "e.ts_utc"), F.lit(""))
    kinds = told.select("path", F.coalesce("e.event", F.lit("?")).alias("event"), ts.alias("ts"), F.when(ts.isNotNull(), F.col("ord")).alias("at"))
    each = kinds.groupBy("path", "event").agg(F.count("*").alias("n"), F.min_by("ts", "at").alias("first"), F.min("at").alias("low"), F.max_by("ts", "at").alias("last"), F.max("at").alias("high"))
    whole = each.groupBy("path").agg(F.min_by("first", "low").alias("first"), F.max_by("last", "high").alias("last"), F.array_sort(F.collect_list(F.struct("event", "n"))).alias("kinds"))  # a few kinds
    listed = F.array_join(F.transform("kinds", lambda k: F.concat(k["event"], F.lit("="), k["n"].cast("string"))), ", ")
    known = lambda c: F.coalesce(c, F.lit("?"))
    return whole.select(known("first").alias("ts"), F.concat(F.lit("watched from "), known("first"), F.lit(" to "), known("last"), F.lit(": "), listed).alias("description"))


def log(*parts: DataFrame) -> DataFrame:
    """no, ts, description of all parts by time and text, numbered by sorted ranges."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return numbered(every.withColumn("_all", F.lit(0)), ["_all", "ts", "description"], ["_all"]).select("no", "ts", "description")


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of every manifest.json below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").load(folder).select("path", "content")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """path, ord, value of the lines of every events.jsonl below a folder; ord ascends with the lines of a file, also of one that's read in several splits."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "events.jsonl").text(folder)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"), "value")
