"""Sinks and small inputs of a case: detail tables as Parquet, one-row summaries as JSON, manifests, checksum lists, raid notes."""

from __future__ import annotations

import hashlib
import json
import re
import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, timeutil
from ..schema import FILES

SUMMARY_ROWS = 10_000


def write_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a detail table and gives it back as read from there."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def summary_json(df: DataFrame) -> str:
    """A small table as JSON with sorted keys; more than SUMMARY_ROWS rows are refused, since they'd go through the driver."""
    rows = df.limit(SUMMARY_ROWS + 1).collect()
    if len(rows) > SUMMARY_ROWS:
        raise ValueError("not a summary: write it as a table")
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, sort_keys=True, default=str)


def manifest(spark: SparkSession, command: str, finished: str, inputs: dict[str, str], version: str = "1") -> DataFrame:
    """One row: what ran, when it was done, and the digest of each input's content, given as 64 hex digits, or else of its name."""
    items = {k: v if re.fullmatch("[0-9a-f]{64}", v) else hashlib.sha256(v.encode()).hexdigest() for k, v in sorted(inputs.items())}
    return spark.createDataFrame([(command, version, finished, items)], "command string, version string, finished_utc string, inputs map<string,string>")


def canonical_json_hash(value) -> str:
    """sha256 of a value as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_csv(df: DataFrame, folder: str) -> None:
    """Rows as CSV with a header in each part; the first name carries the byte order mark that spreadsheet programs look for."""
    first, *rest = df.columns
    df.select(F.col(first).alias("\ufeff" + first), *rest).write.mode("overwrite").csv(folder, header=True)


def markdown(df: DataFrame, title: str) -> str:
    """A small table as Markdown; more than SUMMARY_ROWS rows are refused, not cut."""
    rows = df.limit(SUMMARY_ROWS + 1).collect()
    if len(rows) > SUMMARY_ROWS:
        raise ValueError("not a summary: write it as a table")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""])


def checksum_list(lines: DataFrame) -> DataFrame:
    """name, digest from 'digest  name' lines (value); '*' before a name means binary mode and is dropped."""
    pattern = r"^\s*([0-9a-fA-F]{32,128})\s+\*?(.+?)\s*$"
    return lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 2).alias("name"), F.lower(F.regexp_extract("value", pattern, 1)).alias("digest"))


def parts(files: DataFrame) -> DataFrame:
    """Parts of split archives (path): archive and number, from names such as x.zip.003."""
    pattern = r"^(.*\.zip)\.(\d{3,})$"
    return files.where(F.col("path").rlike(pattern)).withColumns({"archive": F.regexp_extract("path", pattern, 1), "part": F.regexp_extract("path", pattern, 2).cast("int")})


def raid_notes(lines: DataFrame) -> DataFrame:
    """raid_time, notes from 'datetime: ...' and 'notes: ...' lines (value), or else the first line that reads as a time. One row."""
    label = r"(?i)^\s*(datetime|date|time|일시|notes?|비고|메모)\s*[:：]\s*(.*)$"
    key, rest = F.lower(F.regexp_extract("value", label, 1)), F.regexp_extract("value", label, 2)
    timed = key.isin("datetime", "date", "time", "일시")
    labelled = timeutil.lenient_datetime(F.when(timed, rest))
    return lines.agg(F.coalesce(F.min(labelled), F.min(timeutil.lenient_datetime(F.when(key == "", F.col("value"))))).alias("raid_time"), F.array_join(F.array_sort(F.collect_list(F.when(key.isin("note", "notes", "비고", "메모"), rest))), "\n").alias("notes"))


def import_sqlite(spark: SparkSession, path: str, rows: int = 50_000) -> DataFrame:
    """An inventory kept in an SQLite file (table files), read in ranges of row numbers, one a task. The file must be readable on the executors."""
    with sqlite3.connect(f"file:{Path(path).resolve()}?mode=ro", uri=True) as con:
        low, high = con.execute("SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM files").fetchone()
    names = [x.split()[0] for x in FILES.split(", ")]

    def read(batches):
        import pandas as pd

        with sqlite3.connect(f"file:{Path(path).resolve()}?mode=ro", uri=True) as con:
            for b in batches:
                for start in b["id"]:
                    yield pd.read_sql_query(f"SELECT {', '.join(names)} FROM files WHERE rowid BETWEEN ? AND ?", con, params=(int(start), int(start) + rows - 1), dtype_backend="numpy_nullable")

    return spark.range(low, high + 1, rows, max(1, -(-(high + 1 - low) // rows))).mapInPandas(read, FILES)


#: Where a case keeps a step's table, in the order in which they are looked for: itself, its own folder, the steps of a field run.
LAYOUTS = ("{folder}/{name}", "{folder}/{name}/{name}", "{folder}/steps/{name}", "{folder}/steps/{name}/{name}")


def case_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A step's table from an earlier run, as Parquet, or as JSON lines or one JSON text with .json; None if the case has none."""
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    for layout in LAYOUTS:
        at = layout.format(folder=folder.rstrip("/"), name=name)
        for path, read in ((at, spark.read.parquet), (f"{at}.json", lambda p: spark.read.json(p, multiLine=True))):
            if fs(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs(path)):
                return read(path)
    return None


def results_from_json(texts: DataFrame) -> DataFrame:
    """ord, claimed_path, digest, matched_path, status, scope_verdict, missing_now from verify results kept as JSON texts (value) with items."""
    note = "notes array<string>"
    kind = f"items array<struct<claimed_path:string, claimed_sha256:string, matched_path:string, status:string, scope_verdict:string, {note.replace(' ', ':')}>>"
    rows = texts.select(F.posexplode(F.from_json("value", kind)["items"]).alias("at", "i"))
    gone = F.exists(F.coalesce("i.notes", F.array().cast("array<string>")), lambda n: n.contains("absent on current disk"))
    return rows.select(F.col("at").cast("long").alias("ord"), "i.claimed_path", F.col("i.claimed_sha256").alias("digest"), "i.matched_path", "i.status", F.coalesce("i.scope_verdict", F.lit("unknown")).alias("scope_verdict"), gone.alias("missing_now"))


def changes_from_json(texts: DataFrame) -> DataFrame:
    """path, change, backdated from a diff kept as JSON texts (value) with lists added, removed, modified and accessed."""
    entry = "array<struct<path:string, backdated:boolean>>"
    names = ("added", "removed", "modified", "accessed")
    held = texts.select(F.from_json("value", ", ".join(f"{n} {entry}" for n in names)).alias("d"))
    listed = lambda n: F.transform(F.coalesce(F.col(f"d.{n}"), F.array().cast(entry)), lambda e: F.struct(e["path"].alias("path"), F.lit(n).alias("change"), F.coalesce(e["backdated"], F.lit(False)).alias("backdated")))
    every = held.select(F.explode(F.concat(*map(listed, names))).alias("x"))
    return every.select("x.*")


def field_inputs(files: DataFrame) -> DataFrame:
    """kind, path of a folder's inputs (path), by how their names begin: profile (.json, the first), seized (the first that is no PDF, or else
    the first), baseline (the first), info (the last .json, or else the first .txt)."""
    name, ext = F.lower(paths.basename(F.col("path"))), paths.extension(F.col("path"))
    starts = lambda w: name.startswith(w)
    kind = F.when(starts("profile") & (ext == ".json"), F.lit("profile")).when(starts("seized"), F.lit("seized")).when(starts("baseline"), F.lit("baseline")).when(starts("info") & ext.isin(".json", ".txt"), F.lit("info"))
    told = files.select(kind.alias("kind"), "path", ext.alias("ext")).where("kind IS NOT NULL")
    better = F.when(F.col("kind") == "seized", F.col("ext") != ".pdf").when(F.col("kind") == "info", F.col("ext") == ".json").otherwise(F.lit(False))
    picked = told.groupBy("kind").agg(F.min("path").alias("first"), F.min(F.when(better & (F.col("kind") == "seized"), F.col("path"))).alias("text"), F.max(F.when(better & (F.col("kind") == "info"), F.col("path"))).alias("json"))
    return picked.select("kind", F.coalesce("text", "json", "first").alias("path"))
