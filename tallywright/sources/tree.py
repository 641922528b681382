"""A tree of any shape as an inventory, taken by jobs whose tasks are even: walk by levels, stat, and hash only what changed.

walk: each task lists the folders that it is given and goes on below them for LOOKAHEAD entries; folders that it leaves open are the next
level's, dealt anew, so that neither a deep chain nor a wide folder stays with one task. If links are followed, levels are strict, and a
folder is entered once by its real path: at the level where it is first met, there under its least name, whichever tasks meet it.

take_inventory: the walk's names are dealt evenly for their stat; records that an earlier inventory settles keep its digest; the rest, largest
first, are cut by their running total of bytes into tasks of TASK_BYTES, so that a task has that much and one file more at most. A sha256 can't be made
in parts, so a file is never split. Every step is written below the target folder before the next reads it; a step that was lost with its
executor is made again from there."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.inventory import reuse_digests
from ..schema import FILES_READ
from ..session import removed, ship
from .filesystem import hash_file, record

#: Entries that a task goes on below a folder before it leaves the rest to the next level.
LOOKAHEAD = 20_000
TASK_BYTES = 4 << 30
#: What opening a file costs, in bytes that could be read meanwhile.
OPEN_BYTES = 1 << 20
_LISTED = "path string, what string, real string"


def _list(root: str, follow: bool, depth: int | None, lookahead: int):
    """Rows for folders (path): 'entry' for each name below, 'open' for folders still to be listed, 'error' for those that can't be."""
    schema = pa.schema([("path", pa.string()), ("what", pa.string()), ("real", pa.string())])
    goes = lambda rel: depth is None or rel.count("/") + 1 <= depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for first in batch.column("path").to_pylist():
                todo, met = [first], 0
                while todo and (not met or met < lookahead):
                    rel = todo.pop()
                    try:
                        with os.scandir(os.path.join(root, rel) if rel else root) as found:
                            for e in found:
                                path = f"{rel}/{e.name}" if rel else e.name
                                met += 1
                                out.append((path, "entry", None))
                                if e.is_dir(follow_symlinks=follow) and goes(path):
                                    if follow:
                                        out.append((path, "open", os.path.realpath(e.path)))
                                    else:
                                        todo.append(path)
                                if len(out) >= 10_000:
                                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=schema)
                                    out = []
                    except OSError:
                        out.append((rel or ".", "error", None))
                out += [(rel, "open", None) for rel in todo]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], schema=schema)

    return run


def walk(spark: SparkSession, root: str, out: str, follow: bool = False, depth: int | None = None, lookahead: int = LOOKAHEAD) -> DataFrame:
    """path, error of every entry below root, written below out. Folders deeper than depth are entries, but aren't entered. error: a folder
    that can't be listed, besides its own entry ('.' for the root)."""
    ship(spark)
    most = spark.sparkContext.defaultParallelism * 8
    frontier = spark.createDataFrame([("",)], "path string")
    real = spark.range(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"real": [os.path.realpath(root)] * len(b)}) for b in batches), "real string")
    real.write.mode("overwrite").parquet(f"{out}/seen/level=0")
    level, tasks = 0, 1
    while True:
        frontier.repartition(tasks).mapInArrow(_list(root, follow, depth, lookahead), _LISTED).write.mode("overwrite").parquet(f"{out}/listed/level={level}")
        left = spark.read.schema(_LISTED).parquet(f"{out}/listed/level={level}").where("what = 'open'")
        level += 1
        if follow:
            seen = spark.read.schema("real string").parquet(f"{out}/seen")
            new = left.groupBy("real").agg(F.min("path").alias("path")).join(seen, "real", "left_anti")
            new.write.mode("overwrite").parquet(f"{out}/next/level={level}")
            left = spark.read.schema("real string, path string").parquet(f"{out}/next/level={level}")
            left.select("real").write.mode("overwrite").parquet(f"{out}/seen/level={level}")
        folders = left.count()
        if not folders:
            break
        frontier, tasks = left.select("path"), min(folders, most)
    listed = spark.read.schema(_LISTED).parquet(f"{out}/listed")
    return listed.where("what <> 'open'").select("path", (F.col("what") == "error").alias("error"))


def stated(paths: DataFrame, root: str, follow: bool) -> DataFrame:
    """FILES_READ rows, without digests, of entries (path, error)."""
    schema = to_arrow_schema(paths.sparkSession.createDataFrame([], FILES_READ).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, None, None, None, None, None, "error", "stat_error", None) if bad else record(p, os.path.join(root, p), follow) for p, bad in zip(b.column("path").to_pylist(), b.column("error").to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return paths.mapInArrow(run, FILES_READ)


def dealt_by_bytes(todo: DataFrame, out: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """todo (size, path) over one partition for each task_bytes, largest files first: a row's task is its running total over task_bytes.

    The order is made by sorted ranges, each summed on its own; only the ranges' totals meet."""
    spark = todo.sparkSession
    weight = F.coalesce("size", F.lit(0)) + OPEN_BYTES
    ranges = todo.withColumn("_weight", weight).repartitionByRange(F.col("_weight").desc(), F.col("path"))
    ranges.withColumn("_part", F.spark_partition_id()).write.mode("overwrite").parquet(out)
    held = spark.read.parquet(out)
    totals = held.groupBy("_part").agg(F.sum("_weight").alias("_bytes"))
    every = totals.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    before = totals.select("_part", (F.sum("_bytes").over(Window.orderBy("_part")) - F.col("_bytes")).alias("_before"))  # a row for each range
    own = F.sum("_weight").over(Window.partitionBy("_part").orderBy(F.col("_weight").desc(), "path").rowsBetween(Window.unboundedPreceding, -1))
    placed = held.join(F.broadcast(before), "_part").withColumn("_task", F.floor((F.col("_before") + F.coalesce(own, F.lit(0))) / F.lit(task_bytes)).cast("int"))
    return placed.repartitionById(max(1, math.ceil(every / task_bytes)), F.col("_task")).drop("_part", "_weight", "_before", "_task")


def hashed(todo: DataFrame, root: str, follow: bool, limit: int | None) -> DataFrame:
    """FILES_READ rows of files (path, kind ...) as they are now, each opened and read once; one that has gone meanwhile is a read_error."""
    schema = to_arrow_schema(todo.sparkSession.createDataFrame([], FILES_READ).schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.select(names).to_pylist():
                full = os.path.join(root, r["path"])
                try:
                    before = os.stat(full, follow_symlinks=follow)
                    r |= {"sha256": None, "access_mode": None, "size": before.st_size, "mtime_ns": before.st_mtime_ns, "ctime_ns": before.st_ctime_ns, "atime_ns": before.st_atime_ns}
                    r["sha256"], r["status"], r["access_mode"] = hash_file(full, limit, before)
                except OSError:
                    r |= {"sha256": None, "status": "read_error", "access_mode": None}
                rows.append(r)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return todo.mapInArrow(run, FILES_READ)


def take_inventory(
    spark: SparkSession, root: str, out: str, hash_files: bool = True, earlier: DataFrame | None = None, max_hash_bytes: int | None = None, follow: bool = False, depth: int | None = None, task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """FILES_READ and reused of every entry below root, written to out/files. earlier: an inventory whose digests are kept for files of the same
    size and time; only others are opened, and those that are gone don't come back."""
    work = f"{out}/_work"
    stat = stated(walk(spark, root, f"{work}/walk", follow, depth).repartition(spark.sparkContext.defaultParallelism * 4), root, follow)
    previous = earlier if earlier is not None else spark.createDataFrame([], FILES_READ)
    plan = reuse_digests(stat, previous) if hash_files else stat.withColumns({"reused": F.lit(False), "to_hash": F.lit(False)})
    plan.write.mode("overwrite").parquet(f"{work}/plan")
    plan = spark.read.parquet(f"{work}/plan")
    columns = [c.split()[0] for c in FILES_READ.split(", ")]
    rows = plan.where("NOT to_hash").select(*columns, "reused")
    if hash_files:
        todo = dealt_by_bytes(plan.where("to_hash").select(*columns), f"{work}/order", task_bytes)
        rows = rows.unionByName(hashed(todo, root, follow, max_hash_bytes).withColumn("reused", F.lit(False)))
    rows.write.mode("overwrite").parquet(f"{out}/files")
    removed(spark, work)
    return spark.read.parquet(f"{out}/files")
