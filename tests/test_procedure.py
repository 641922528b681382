"""A case's log from its folders, and archives joined from parts."""

import hashlib
import json

from tallywright import case
from tallywright.operators import custody, procedure
from tallywright.session import ship


def test_log_of_folders(spark, tmp_path):
    home = tmp_path / "case"
    for name, text in {"scan": json.dumps({"finished_utc": "2026-01-02T00:00:00", "command": "scan"}), "diff": json.dumps({"command": "diff"}), "bad": "{"}.items():
        (home / name).mkdir(parents=True)
        (home / name / "manifest.json").write_text(text)
    (home / "watch").mkdir()
    lines = [{"event": "session_start", "ts": "2026-01-03"}, {"event": "created", "ts_utc": "2026-01-01"}, {"event": "created"}, {"ts": "2026-01-04"}, {"event": "removed", "ts": "2025-12-31"}]
    (home / "watch" / "events.jsonl").write_text("\n".join([*map(json.dumps, lines), "torn {", ""]))
    ship(spark)
    rows = procedure.log(procedure.steps(procedure.read_manifests(spark, str(home))), procedure.watches(procedure.read_events(spark, str(home)))).orderBy("no").collect()
    digest = lambda n: hashlib.sha256((home / n / "manifest.json").read_bytes()).hexdigest()[:16]
    assert [(r["no"], r["ts"], r["description"]) for r in rows] == [
        (1, "2026-01-02T00:00:00", f"scan finished (scan/, manifest {digest('scan')})"),
        (2, "2026-01-03", "watched from 2026-01-03 to 2025-12-31: ?=1, created=2, removed=1, session_start=1"),
        (3, "?", f"? finished (bad/, manifest {digest('bad')})"),
        (4, "?", f"diff finished (diff/, manifest {digest('diff')})"),
    ]
    assert case.main(["procedure", "--case", str(home), "--out", str(tmp_path / "out")]) == 0
    index = {r["path"]: r["sha256"] for r in spark.read.parquet(str(tmp_path / "out" / "index")).collect()}
    assert index["watch/events.jsonl"] == hashlib.sha256((home / "watch" / "events.jsonl").read_bytes()).hexdigest() and len(index) == 4


def test_rejoined_archives(spark, tmp_path):
    ship(spark)
    data = {"ok": [b"ab", b"", b"c"], "changed": [b"x", b"y"], "lost": [b"1", None, b"3", None, b"5"], "unknown": [b"u"], "headless": [None, b"2"]}
    rows = [(a, i, bytearray(p)) for a, parts in data.items() for i, p in enumerate(parts, 1) if p is not None]
    whole = lambda a: hashlib.sha256(b"".join(p or b"" for p in data[a])).hexdigest()
    told = [("ok", whole("ok").upper()), ("changed", whole("ok")), ("lost", whole("lost")), ("headless", None), ("unknown", "")]
    got = {r["archive"]: (r["parts"], r["bytes"], r["sha256"], r["missing"], r["verdict"]) for r in custody.rejoined(spark.createDataFrame(rows, "archive string, part int, content binary").repartition(5), spark.createDataFrame(told, "archive string, digest string")).collect()}
    assert got == {"ok": (3, 3, whole("ok"), 0, "ok"), "changed": (2, 2, whole("changed"), 0, "mismatch"), "lost": (3, 3, whole("lost"), 2, "missing_part"), "unknown": (1, 1, whole("unknown"), 0, "unverifiable"), "headless": (1, 1, whole("headless"), 1, "missing_part")}
    assert custody.rejoined(spark.createDataFrame([], "archive string, part int, content binary"), spark.createDataFrame(told, "archive string, digest string")).count() == 0
    home = tmp_path / "parts"
    home.mkdir()
    for i, p in enumerate([b"one", b"two"], 1):
        (home / f"x.zip.{i:03}").write_bytes(p)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    (tmp_path / "sums.txt").write_text(f"{digest(b'onetwo')}  x.zip\n{digest(b'one')}  x.zip.001\n{digest(b'other')}  x.zip.002\n")
    assert case.main(["rejoin", "--parts", str(home), "--sums", str(tmp_path / "sums.txt"), "--out", str(tmp_path / "out")]) == 0
    assert [r["verdict"] for r in spark.read.parquet(str(tmp_path / "out" / "archives")).collect()] == ["ok"]
    assert {r["name"]: r["verdict"] for r in spark.read.parquet(str(tmp_path / "out" / "parts")).collect()} == {"x.zip": "missing", "x.zip.001": "ok", "x.zip.002": "mismatch"}
