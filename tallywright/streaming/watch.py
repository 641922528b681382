"""Change monitor: snapshots arrive pass by pass; each is held against the one before.

Removals are absences: every bucket of paths hears of every pass, so that it finds what it held and no longer sees. The state holds one pass,
whatever the number of passes, and a pass writes to it where it found changes. The first pass only sets it. A restart goes on from the
checkpoint, and a batch that is made again replaces the part of events that it had written."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..session import ship

SNAPSHOT = "pass long, path string, size long, mtime_ns long, kind string"
EVENTS = "pass long, event string, path string, size long, mtime_ns long"
#: Parts that the state is dealt in: some hundred thousand paths each for a pass of a few hundred millions.
BUCKETS = 1024
#: Stands for an unknown size or time in the state.
UNKNOWN = -(2**63)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """event (created, removed, modified), path, size, mtime_ns between two snapshots; a change of kind alone is none."""
    b = before.select(F.col("path").alias("p"), F.col("size").alias("s"), F.col("mtime_ns").alias("m"))
    j = after.select("path", "size", "mtime_ns").join(b, F.col("path") == F.col("p"), "full_outer")
    event = F.when(F.col("p").isNull(), F.lit("created")).when(F.col("path").isNull(), F.lit("removed")).when(~(F.col("size").eqNullSafe(F.col("s")) & F.col("mtime_ns").eqNullSafe(F.col("m"))), F.lit("modified"))
    return j.select(event.alias("event"), F.coalesce("path", "p").alias("path"), F.coalesce("size", "s").alias("size"), F.coalesce("mtime_ns", "m").alias("mtime_ns")).where("event IS NOT NULL")


def process_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """event (process_started, process_ended), pid, name between two process tables (pid, name)."""
    started = after.join(before.select("pid"), "pid", "left_anti").select(F.lit("process_started").alias("event"), "pid", "name")
    return started.unionByName(before.join(after.select("pid"), "pid", "left_anti").select(F.lit("process_ended").alias("event"), "pid", "name"))


def all_passes(snapshots: DataFrame) -> DataFrame:
    """Batch form over a table of snapshots (SNAPSHOT): pass, event, path of every pass after the first; one shuffle by path.

    A path that a pass lists twice counts once, with its greatest size and time."""
    order = Window.orderBy("pass")  # one row for each pass
    passes = snapshots.select("pass").distinct().select("pass", F.lag("pass").over(order).alias("_prior"), F.lead("pass").over(order).alias("_next"))
    own = Window.partitionBy("path").orderBy("pass")
    held = snapshots.groupBy("path", "pass").agg(F.max(F.struct("size", "mtime_ns")).alias("v"))
    seen = held.withColumns({"was": F.lag(F.struct("pass", "v")).over(own), "then": F.lead("pass").over(own)}).join(passes, "pass")
    before = F.col("was.pass").eqNullSafe(F.col("_prior"))
    here = F.when(F.col("_prior").isNotNull(), F.when(~before, F.lit("created")).when(F.col("v") != F.col("was.v"), F.lit("modified")))
    gone = F.when(F.col("_next").isNotNull() & ~F.col("then").eqNullSafe(F.col("_next")), F.lit("removed"))
    each = seen.select("path", F.explode(F.array(F.struct(F.col("pass").alias("at"), here.alias("event")), F.struct(F.col("_next").alias("at"), gone.alias("event")))).alias("x"))
    return each.select(F.col("x.at").alias("pass"), "x.event", "path").where("event IS NOT NULL")


def pass_summary(events: DataFrame) -> DataFrame:
    """pass, event, items of the monitor's events; the first pass counts as snapshot_init."""
    return events.groupBy("pass", "event").agg(F.count("*").alias("items"))


class StopMarker(StreamingQueryListener):
    """Appends a line with the time and the reason to a table of stops when the query of that id ends, by stop() or by an error."""

    def __init__(self, spark: SparkSession, folder: str, query_id: str):
        self.spark, self.folder, self.query_id = spark, folder, query_id

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query_id:
            row = [(dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), "failed" if event.exception else "stopped")]
            self.spark.createDataFrame(row, "at_utc string, reason string").write.mode("append").parquet(self.folder)


def _marked(buckets: int):
    """Rows as they come, and after them for each pass that the task has seen a row without a path for every bucket: so that buckets hear of passes
    in which they have no path left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        schema = None
        for b in batches:
            schema = b.schema
            seen |= set(pc.unique(b.column("pass")).to_pylist())
            yield b
        for number in sorted(seen):
            none = {"path": pa.nulls(buckets, pa.string()), **{c: pa.array(np.zeros(buckets, np.int64)) for c in ("size", "mtime_ns")}}
            yield pa.RecordBatch.from_pydict({"pass": np.full(buckets, number)} | none | {"bucket": np.arange(buckets, dtype=np.int32)}, schema=schema)

    return run


def _pass(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events of a bucket's paths, pass by pass; the state is written only if something has changed."""
    now = pd.concat(list(rows))
    if state.exists:
        held = pa.ipc.open_stream(state.get[0]).read_all()
        paths, values = pd.Index(held["path"].to_pylist()), np.stack([held["size"].to_numpy(), held["mtime_ns"].to_numpy()], 1)
    else:
        paths, values = pd.Index([], dtype=object), np.zeros((0, 2), np.int64)
    changed = False
    for number, own in now.groupby("pass", sort=True):
        own = own[own["path"].notna()].sort_values(["size", "mtime_ns"]).drop_duplicates("path", keep="last")
        after, then = pd.Index(own["path"], dtype=object), own[["size", "mtime_ns"]].to_numpy(np.int64)
        was = paths.get_indexer(after)
        gone = np.ones(len(paths), bool)
        gone[was[was >= 0]] = False
        other = np.zeros(len(after), bool)
        other[was >= 0] = (then[was >= 0] != values[was[was >= 0]]).any(1)
        found = [("created", after[was < 0], then[was < 0]), ("modified", after[other], then[other]), ("removed", paths[gone], values[gone])]
        if key[0] == 0:
            found.append((None, [None], np.zeros((1, 2), np.int64)))  # tells of the pass itself
        for event, names, v in found:
            if len(names):
                changed |= event is not None
                yield pd.DataFrame({"pass": number, "event": [event] * len(names), "path": list(names), "size": v[:, 0], "mtime_ns": v[:, 1]})
        paths, values = after, then
    if changed and len(paths):
        table, sink = pa.table({"path": pa.array(list(paths), pa.string()), "size": values[:, 0], "mtime_ns": values[:, 1]}), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
    elif changed:
        state.remove()


def start(snapshots: DataFrame, events: str, checkpoint: str, once: bool = True, interval: str = "5 seconds", buckets: int = BUCKETS) -> StreamingQuery:
    """Runs the monitor over a stream of snapshot rows (SNAPSHOT); a pass must lie in one micro-batch, which may hold several. A row without a path only tells that
    there was a pass. Events (EVENTS) go to the folder events, a part for each micro-batch, which a repeated one replaces; the first pass is one
    snapshot_init, whose size is its number of entries.

    The state is the last pass, dealt over buckets by path, so that a pass of any size is even work; it lies in the checkpoint, and what didn't change isn't
    written again. buckets can't be changed later; a task holds a bucket's part of a pass, some 100 bytes a path."""
    ship(snapshots.sparkSession)
    number = lambda c: F.coalesce(c, F.lit(UNKNOWN))
    keyed = snapshots.select("pass", "path", number("size").alias("size"), number("mtime_ns").alias("mtime_ns"), F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket"))
    marked = keyed.mapInArrow(_marked(buckets), keyed.schema)
    found = marked.groupBy("bucket").applyInPandasWithState(_pass, EVENTS, "held binary", "append", "NoTimeout")
    known = lambda c: F.when(F.col(c) != UNKNOWN, F.col(c)).alias(c)

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:  # the first pass sets the state
            batch = batch.persist()
            first = batch.agg(F.min("pass")).first()[0]
            if first is not None:
                entries = batch.where((F.col("pass") == first) & F.col("event").isNotNull()).count()
                init = spark.createDataFrame([(first, "snapshot_init", None, entries, None)], EVENTS)
                batch = batch.where(F.col("pass") > first).unionByName(init)
        batch.where("event IS NOT NULL").select("pass", "event", "path", known("size"), known("mtime_ns")).write.mode("overwrite").parquet(f"{events}/batch={number}")

    writer = found.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def monitored(spark: SparkSession, events: str) -> DataFrame:
    """The monitor's events so far (EVENTS)."""
    return spark.read.schema(f"{EVENTS}, batch long").option("basePath", events).parquet(events).drop("batch")
