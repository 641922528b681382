"""The change monitor, pass by pass, with a restart in between."""

import random
import time
from pathlib import Path

from tallywright.session import ship
from tallywright.sources.tree_stream import TreeStream
from tallywright.streaming import watch


def put(spark, folder, number, files):
    spark.createDataFrame([(number, p, s, m, "file") for p, (s, m) in files.items()], watch.SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder):
    stream = spark.readStream.schema(watch.SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    watch.start(stream, f"{folder}/events", f"{folder}/checkpoint", buckets=8).awaitTermination()
    return sorted((r["pass"], r["event"], r["path"]) for r in watch.monitored(spark, f"{folder}/events").collect())


def test_watch(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, 1, {"a": (1, 1), "b": (1, 1)})
    assert run(spark, folder) == [(1, "snapshot_init", None)]
    put(spark, folder, 2, {"a": (2, 1), "c": (1, 1)})
    assert run(spark, folder)[1:] == [(2, "created", "c"), (2, "modified", "a"), (2, "removed", "b")]
    put(spark, folder, 3, {"a": (2, 1), "c": (1, 1)})
    assert len(run(spark, folder)) == 4


def folder_bytes(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def test_passes_against_batch(spark, tmp_path):
    """Random passes, one or several a micro-batch, with restarts, repeats, unknown sizes and buckets that run empty: the events of all_passes."""
    rnd = random.Random(11)
    rows, snapshot = [], {}
    for number in range(2, 12):
        for path in [f"p{i}" for i in range(12)]:
            if rnd.random() < 0.4:
                snapshot[path] = (rnd.choice([None, 1, 2]), 1_700_000_000_000_000_000 + rnd.randrange(3))
            elif rnd.random() < 0.4:
                snapshot.pop(path, None)
        if number in (5, 9):
            snapshot = {k: v for k, v in snapshot.items() if k == "p1"} or {"p1": (1, 1)}
        rows.append([(number, p, s, m, "file") for p, (s, m) in snapshot.items()])
    folder = str(tmp_path)
    for i, some in enumerate([rows[:1], rows[1:4], rows[4:5], rows[5:10]]):
        spark.createDataFrame(sum(some, []), watch.SNAPSHOT).coalesce(1).write.parquet(f"{folder}/in{i}")
    stream = lambda i: spark.readStream.schema(watch.SNAPSHOT).parquet(f"{folder}/all")
    for i in range(4):
        spark.read.parquet(f"{folder}/in{i}").coalesce(1).write.mode("append").parquet(f"{folder}/all")
        watch.start(stream(i), f"{folder}/events", f"{folder}/checkpoint", buckets=16).awaitTermination()
    got = watch.monitored(spark, f"{folder}/events")
    assert [(r["pass"], r["size"]) for r in got.where("event = 'snapshot_init'").collect()] == [(2, len(rows[0]))]
    want = watch.all_passes(spark.createDataFrame(sum(rows, []), watch.SNAPSHOT))
    assert sorted(tuple(r) for r in got.where("event <> 'snapshot_init'").select("pass", "event", "path").collect()) == sorted(tuple(r) for r in want.collect())
    last = got.where("event = 'modified'").select("pass", "path", "size", "mtime_ns").collect()
    assert last and all((r["pass"], r["path"], r["size"], r["mtime_ns"], "file") in sum(rows, []) for r in last)


def test_state_holds_one_pass(spark, tmp_path):
    """Passes without a change write no state: after seven of them it's as large as after one."""
    folder, sizes = str(tmp_path), []
    for number in range(1, 9):
        put(spark, folder, number, {f"path/{i}": (i, 1) for i in range(3000)})
        assert run(spark, folder) == [(1, "snapshot_init", None)]
        sizes.append(folder_bytes(f"{folder}/checkpoint/state"))
    assert sizes[-1] < 2 * sizes[1], sizes


def test_folder_as_stream(spark, tmp_path):
    """A tree itself, pass by pass, with a restart between any two: nothing, created, modified, removed, and emptied."""
    spark.dataSource.register(TreeStream)
    ship(spark)
    top, out = tmp_path / "top", str(tmp_path / "out")
    (top / "a").mkdir(parents=True)

    def watched():
        stream = spark.readStream.format("tree").load(str(top))
        watch.start(stream, f"{out}/events", f"{out}/checkpoint", buckets=4).awaitTermination()
        rows = watch.monitored(spark, f"{out}/events").orderBy("pass").collect()
        number = max(r["pass"] for r in rows)
        return [(r["event"], r["path"]) for r in rows if r["pass"] == number], len({r["pass"] for r in rows})

    (top / "a" / "x").write_text("1")
    (top / "y").write_text("1")
    assert watched() == ([("snapshot_init", None)], 1)
    assert watched() == ([("snapshot_init", None)], 1)
    (top / "a" / "x").write_text("longer")
    (top / "b").mkdir()
    (top / "b" / "z").write_text("1")
    got, passes = watched()
    assert sorted(e for e in got if e[1] not in ("a",)) == [("created", "b"), ("created", "b/z"), ("modified", "a/x")] and passes == 2
    (top / "y").unlink()
    got, passes = watched()
    assert got == [("removed", "y")] and passes == 3
    for p in ("a/x", "b/z"):
        (top / p).unlink()
    for p in "ab":
        (top / p).rmdir()
    got, passes = watched()
    assert sorted(got) == [("removed", "a"), ("removed", "a/x"), ("removed", "b"), ("removed", "b/z")] and passes == 4
    assert watched()[1] == 4


def test_folder_as_stream_goes_on_by_itself(spark, tmp_path):
    spark.dataSource.register(TreeStream)
    ship(spark)
    top, out = tmp_path / "top", str(tmp_path / "out")
    top.mkdir()
    q = watch.start(spark.readStream.format("tree").load(str(top)), f"{out}/events", f"{out}/checkpoint", once=False, interval="1 second", buckets=2)
    try:
        found = lambda: {r["path"] for r in watch.monitored(spark, f"{out}/events").where("event = 'created'").collect()} if (tmp_path / "out" / "events").exists() else set()
        until = time.time() + 120
        while not list((tmp_path / "out").glob("events/batch=0/_SUCCESS")) and time.time() < until:
            time.sleep(0.5)
        (top / "late").write_text("1")
        while "late" not in found() and time.time() < until:
            time.sleep(1)
    finally:
        q.stop()
    assert found() == {"late"} and q.exception() is None


def test_processes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "pid int, name string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "pid int, name string")
    assert sorted(tuple(r) for r in watch.process_changes(a, b).collect()) == [("process_ended", 1, "x"), ("process_started", 3, "z")]


def test_all_passes(spark):
    """The batch form: a path that comes back, one that a pass lists twice, and one that never changes."""
    rows = [(1, "a", 1), (3, "a", 1), (7, "a", 2), (1, "b", 1), (3, "b", 1), (3, "b", 5), (7, "b", 5), (1, "c", 1), (7, "c", 1), (3, "d", 1)]
    df = spark.createDataFrame([(n, p, s, 1, "file") for n, p, s in rows], watch.SNAPSHOT)
    events = watch.all_passes(df)
    assert sorted(tuple(r) for r in events.collect()) == [(3, "created", "d"), (3, "modified", "b"), (3, "removed", "c"), (7, "created", "c"), (7, "modified", "a"), (7, "removed", "d")]
    assert {(r["pass"], r["event"]): r["items"] for r in watch.pass_summary(events).collect()}[7, "created"] == 1
    assert watch.all_passes(df.limit(0)).count() == 0


def test_stop_marker(spark, tmp_path):
    from types import SimpleNamespace

    marker = watch.StopMarker(spark, f"{tmp_path}/stops", "q1")
    for query in ("other", "q1"):
        marker.onQueryTerminated(SimpleNamespace(id=query, exception=None))
    assert [r["reason"] for r in spark.read.parquet(f"{tmp_path}/stops").collect()] == ["stopped"]
