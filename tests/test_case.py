"""A whole case over small inputs, its sinks and inputs."""

import sqlite3

from tallywright import case, schema
from tallywright.plans.criteria import Keyword, Profile
from tallywright.session import ship
from tallywright.sources import claims, reports


def inventory(spark):
    rows = [(f"docs/{n}", 10 * i, 10**18 + i, 10**18 + i, 10**18 + i, f"{i:064x}", "file", "ok") for i, n in enumerate(["계약서.hwp", "notes.txt", "report.pdf", "FTKImager.exe"])]
    return spark.createDataFrame(rows, schema.FILES)


def test_case(spark, tmp_path):
    (tmp_path / "l.txt").write_text(f"C:\\docs\\notes.txt\n{1:064x}  docs/notes.txt\n{9:064x}  report.pdf\nd0cs/계약서.hwp\nmissing/zzz.bin\n")
    items = claims.read_claims(spark, str(tmp_path / "l.txt"))
    made = case.run_case(spark, inventory(spark), items, Profile(keywords=(Keyword("notes"),), extensions=(".txt",)), str(tmp_path / "out"), inventory(spark).where("path <> 'docs/notes.txt'"), 10**18, 10**18 + 1)
    got = [(r["status"], r["tier"], r["scope_verdict"]) for r in made["verify"].orderBy("ord").collect()]
    assert got == [("verified", "exact", "in_scope"), ("verified", "exact", "in_scope"), ("hash_mismatch", "suffix", "out_of_scope"), ("verified", "fuzzy", "out_of_scope"), ("not_in_inventory", None, "unknown")]
    assert made["diff_summary"].first()["removed"] == 1 and made["tools"].first()["label"] == "FTK Imager"
    assert {r["path"] for r in made["window"].collect()} == {"docs/계약서.hwp", "docs/notes.txt"}
    assert "fuzzy_matched" in reports.summary_json(made["verify_summary"])
    assert reports.markdown(made["scan_summary"], "Scan").startswith("# Scan")
    assert made["manifest"].count() == 1
    steps = {r["step"]: r["status"] for r in made["steps"].collect()}
    assert {s for s, v in steps.items() if v == "skipped"} == {"journal", "journal_summary", "certificate", "artifacts", "artifact_tools"} and "failed" not in steps.values()
    broken = case.run_case(spark, inventory(spark), items.drop("rel"), Profile(), str(tmp_path / "broken"))
    assert {r["step"]: r["status"] for r in broken["steps"].collect()} | {"verify": "failed", "boundary": "skipped", "scan": "ok"} == {r["step"]: r["status"] for r in broken["steps"].collect()}
    (tmp_path / "p.json").write_text("{")
    (tmp_path / "i").mkdir()
    assert case.main(["scan", "--inventory", str(tmp_path / "i"), "--profile", str(tmp_path / "p.json"), "--out", str(tmp_path / "o")]) == 1


def test_small_inputs(spark, tmp_path):
    ship(spark)
    lines = spark.createDataFrame([("datetime: 2025년 1월 11일 오후 2시 30분",), ("notes: a",), ("x",)], "value string")
    got = reports.raid_notes(lines).first()
    assert str(got["raid_time"]) == "2025-01-11 14:30:00" and got["notes"] == "a"
    assert reports.raid_notes(lines.where("value = 'x'")).first()["raid_time"] is None
    sums = spark.createDataFrame([("AA" * 32 + " *x.zip.001",), ("no",)], "value string")
    assert [tuple(r) for r in reports.checksum_list(sums).collect()] == [("x.zip.001", "aa" * 32)]
    files = spark.createDataFrame([("a/x.zip.002",), ("b",)], "path string")
    assert [(r["archive"], r["part"]) for r in reports.parts(files).collect()] == [("a/x.zip", 2)]
    assert reports.canonical_json_hash({"b": 1, "a": [2]}) == reports.canonical_json_hash({"a": [2], "b": 1})
    with sqlite3.connect(tmp_path / "i.db") as con:
        con.execute("CREATE TABLE files (path TEXT PRIMARY KEY, size INT, mtime_ns INT, ctime_ns INT, atime_ns INT, sha256 TEXT, kind TEXT, status TEXT)")
        con.executemany("INSERT INTO files VALUES (?, ?, 1, 1, 1, NULL, 'file', 'ok')", [(f"f{i}", i) for i in range(25)])
    assert reports.import_sqlite(spark, str(tmp_path / "i.db"), rows=10).count() == 25
    reports.write_csv(files, str(tmp_path / "csv"))
    assert any(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in (tmp_path / "csv").glob("part-*"))
