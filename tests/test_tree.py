"""Inventories of trees by jobs: walk by levels, aliases, tasks by bytes, and hashing of what changed only."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallywright import case, schema
from tallywright.operators import inventory
from tallywright.sources import tree


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


@pytest.fixture
def root(tmp_path):
    """A chain of folders with a wide one at its end, and some beside it."""
    top = tmp_path / "root"
    deep = top.joinpath(*[f"d{i}" for i in range(12)])
    for i in range(400):
        put(deep / f"f{i}", b"x" * (i % 7))
    for i in range(30):
        put(top / f"side{i % 5}" / f"{i}.txt", str(i).encode())
    (top / "empty").mkdir()
    return top


def plain(top):
    return sorted(os.path.relpath(os.path.join(at, n), top) for at, folders, files in os.walk(top) for n in folders + files)


@pytest.mark.parametrize("lookahead", [1, 50, 10_000])
def test_walk_by_levels(spark, root, tmp_path, lookahead):
    got = tree.walk(spark, str(root), str(tmp_path / "w"), lookahead=lookahead)
    assert sorted(r["path"] for r in got.where("NOT error").collect()) == plain(root) and got.where("error").count() == 0
    levels = len(list((tmp_path / "w" / "listed").glob("level=*")))
    assert levels == {1: 13, 10_000: 1}.get(lookahead, levels) and levels <= 13
    some = tree.walk(spark, str(root), str(tmp_path / "v"), depth=2, lookahead=lookahead)
    assert sorted(r["path"] for r in some.collect()) == [p for p in plain(root) if p.count("/") <= 2]


def test_missing_root_is_an_error_row(spark, tmp_path):
    got = tree.take_inventory(spark, str(tmp_path / "nothing"), str(tmp_path / "o"))
    assert [(r["path"], r["kind"], r["status"]) for r in got.collect()] == [(".", "error", "stat_error")]


def test_aliases_give_their_subtree_once(spark, tmp_path):
    top = tmp_path / "root"
    put(top / "a" / "deep" / "own" / "x", b"1")
    put(top / "b" / "y", b"2")
    (top / "a" / "to_b").symlink_to(top / "b")  # met from a, b itself, and c in different tasks
    (top / "c").symlink_to(top / "b")
    (top / "a" / "up").symlink_to(top)
    (top / "b" / "back").symlink_to(top / "a" / "deep")
    (top / "gone").symlink_to(top / "nothing")
    outside = tmp_path / "outside"
    put(outside / "z", b"3")
    (top / "o1").symlink_to(outside)
    (top / "o2").symlink_to(outside)
    got = {r["path"]: r["kind"] for r in tree.take_inventory(spark, str(top), str(tmp_path / "o"), follow=True).collect()}
    assert got == {"a": "dir", "a/deep": "dir", "a/deep/own": "dir", "a/deep/own/x": "file", "a/to_b": "dir", "a/up": "dir", "b": "dir", "b/y": "file", "b/back": "dir", "c": "dir", "gone": "error", "o1": "dir", "o1/z": "file", "o2": "dir"}
    links = {r["path"]: r["kind"] for r in tree.take_inventory(spark, str(top), str(tmp_path / "n")).collect()}
    assert links["c"] == links["gone"] == links["o1"] == "symlink" and "o1/z" not in links and "a/deep/own/x" in links


def test_tasks_by_bytes(spark, tmp_path):
    rnd = random.Random(3)
    sizes = [int(10 ** rnd.uniform(3, 8)) for _ in range(3000)] + [50_000_000] * 300 + [900_000_000]
    todo = spark.createDataFrame([(f"p{i}", s) for i, s in enumerate(sizes)], "path string, size long")
    most = 400_000_000
    dealt = tree.dealt_by_bytes(todo, str(tmp_path / "o"), most)
    loads = [r["b"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum(F.col("size") + tree.OPEN_BYTES).alias("b")).collect()]
    assert dealt.count() == len(sizes) and sorted(r["size"] for r in dealt.collect()) == sorted(sizes)
    total = sum(sizes) + tree.OPEN_BYTES * len(sizes)
    assert sum(loads) == total and dealt.rdd.getNumPartitions() == -(-total // most)
    assert sorted(loads)[-2] <= most + 100_000_000 + tree.OPEN_BYTES and max(loads) <= 900_000_000 + most
    assert tree.dealt_by_bytes(todo.limit(0), str(tmp_path / "e"), most).count() == 0


def test_only_changed_files_are_opened(spark, tmp_path):
    """Of 1,000 files ten change, one is new and one is gone. The others' contents are exchanged behind size and time: who opened them would see."""
    top = tmp_path / "root"
    for i in range(1000):
        put(top / f"d{i % 20}" / f"{i}.bin", f"{i:05d}".encode())
    before = tree.take_inventory(spark, str(top), str(tmp_path / "one"))
    digest = lambda data: hashlib.sha256(data).hexdigest()
    assert {r["path"]: r["sha256"] for r in before.where("kind = 'file'").collect()} == {f"d{i % 20}/{i}.bin": digest(f"{i:05d}".encode()) for i in range(1000)}
    assert before.where("access_mode IS NOT NULL").count() == 1000 and before.where("reused").count() == 0
    for i in range(1000):
        p = top / f"d{i % 20}" / f"{i}.bin"
        s = p.stat()
        if i < 10:
            p.write_bytes(b"changed!" if i % 2 else b"CHANG")  # other size, or the same and another time
            os.utime(p, ns=(s.st_atime_ns, s.st_mtime_ns + 10**9))
        else:
            p.write_bytes(b"?????")
            os.utime(p, ns=(s.st_atime_ns, s.st_mtime_ns))
    put(top / "new" / "n", b"n")
    (top / "d19" / "999.bin").unlink()
    after = tree.take_inventory(spark, str(top), str(tmp_path / "two"), earlier=before, task_bytes=4 << 20)
    rows = {r["path"]: r for r in after.where("kind = 'file'").collect()}
    assert len(rows) == 1000 and "d19/999.bin" not in rows
    opened = {p for p, r in rows.items() if r["access_mode"] is not None}
    assert opened == {f"d{i}/{i}.bin" for i in range(10)} | {"new/n"}
    for p, r in rows.items():
        i = int(p.split("/")[1].split(".")[0]) if p != "new/n" else None
        want = b"n" if i is None else (b"changed!" if i % 2 else b"CHANG") if i < 10 else f"{i:05d}".encode()
        assert r["sha256"] == digest(want) and r["status"] == "ok" and r["reused"] == (p not in opened)
    said = {r["key"]: json.loads(r["value"]) for r in inventory.meta(after, "/r", "t").collect()}
    assert said["reused"] == 989 and said["access_mode"] in ("o_noatime", "restored") and said["kinds"] == {"file": 1000, "dir": 21}
    assert not (tmp_path / "two" / "_work").exists()


def test_oversize_and_vanished_files(spark, tmp_path):
    top = tmp_path / "root"
    put(top / "big", b"x" * 100)
    put(top / "small", b"x")
    one = tree.take_inventory(spark, str(top), str(tmp_path / "one"), max_hash_bytes=10)
    assert {r["path"]: (r["status"], r["access_mode"]) for r in one.collect()}["big"] == ("hash_skipped_oversize", "skipped")
    again = tree.take_inventory(spark, str(top), str(tmp_path / "two"), max_hash_bytes=10, earlier=one)
    assert again.where("reused").count() == 2 and again.where("access_mode IS NOT NULL").count() == 0
    gone = spark.createDataFrame([("gone", 3, 1, 1, 1, None, "file", "ok", None)], schema.FILES_READ)
    assert [(r["size"], r["sha256"], r["status"]) for r in tree.hashed(gone, str(top), False, None).collect()] == [(3, None, "read_error")]


def test_inventory_command(spark, tmp_path):
    top = tmp_path / "root"
    put(top / "a", b"a")
    put(top / "b", b"b")
    assert case.main(["inventory", "--root", str(top), "--out", str(tmp_path / "one"), "--hash"]) == 0
    put(top / "b", b"BB")
    put(top / "c", b"c")
    assert case.main(["inventory", "--root", str(top), "--out", str(tmp_path / "two"), "--hash", "--earlier", str(tmp_path / "one" / "files")]) == 0
    rows = {r["path"]: (r["sha256"], r["reused"]) for r in spark.read.parquet(str(tmp_path / "two" / "files")).collect()}
    assert rows == {n: (hashlib.sha256(t).hexdigest(), n == "a") for n, t in {"a": b"a", "b": b"BB", "c": b"c"}.items()}


def test_access_mode_rollup(spark):
    rolled = lambda *m: spark.range(1).select(inventory.access_mode(F.array(*map(F.lit, m)).cast("array<string>"))).first()[0]
    assert [rolled(), rolled("o_noatime"), rolled("restored"), rolled("none", "skipped"), rolled("o_noatime", "none"), rolled("o_noatime", "restored"), rolled("skipped")] == ["n/a", "o_noatime", "restored", "none", "mixed", "mixed", "none"]
