"""Artifacts, certificate packages, petitions, re-read results and the command line. Inputs are built here."""

import hashlib
import io
import json
import shutil
import struct
import subprocess
import sys
import zipfile
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_sources import FILETIME, cell, workbook

from tallywright import case, schema
from tallywright.functions import timeutil
from tallywright.operators import artifacts, certificate, custody, evidence, inventory, resolve, scan
from tallywright.plans.criteria import Keyword, Profile, load_hash_sets
from tallywright.session import ship
from tallywright.sources import claims, parsers, reports
from tallywright.sources.filesystem import FilesystemSource

ISO = "2024-05-01T00:00:00+00:00"
ROWS = "path string, hive string, key_path string, value_name string, type_id long, data binary, last_write long"


def hive(spark, rows):
    ship(spark)
    rows = [(f"c/{h}", h, k, n, t, None if d is None else bytearray(d), FILETIME) for h, k, n, t, d in rows]
    return spark.createDataFrame(rows, ROWS).withColumn("rel", F.lower(F.regexp_replace("key_path", "^[^/]*/?", "")))


def wide(text):
    return text.encode("utf-16-le")


def shim_entry(path):
    return b"00ts" + struct.pack("<IIIQQ", 0, 32 + len(wide(path)), len(wide(path)), FILETIME, 0) + wide(path)


def test_hive_sections(spark):
    ua = "R/Software/Microsoft/Windows/CurrentVersion/Explorer/UserAssist/{1}/Count"
    usb = "R/ControlSet001/Enum/USBSTOR/Disk&Ven_X/123"
    rows = hive(spark, [
        ("system", "R/ControlSet001/Control/Session Manager/AppCompatCache", "AppCompatCache", 3, shim_entry("C:\\t\\FTKImager.exe") + shim_entry("C:\\b.exe")),
        ("system", "R/ControlSet002/Control/Session Manager/AppCompatCache", "AppCompatCache", 3, b"\1\2" + wide("C:\\old\\x.exe") + b"\0\0"),
        ("system", "R/Other/Control/Session Manager/AppCompatCache", "AppCompatCache", 3, shim_entry("C:\\no.exe")),
        ("system", usb, None, None, None), ("system", usb, "FriendlyName", 1, wide("Stick\0")), ("system", "R/ControlSet001/Enum/USBSTOR/Disk&Ven_X", None, None, None),
        ("ntuser.dat", ua, "P:\\KAPE.rkr", 3, bytes(4) + struct.pack("<I", 5) + bytes(52) + struct.pack("<Q", FILETIME)),
        ("ntuser.dat", ua, "fubeg", 3, bytes(4) + struct.pack("<IQ", 6, FILETIME)), ("ntuser.dat", ua, "gval", 3, b"x"),
        ("ntuser.dat", "R/Software/Microsoft/Windows/CurrentVersion/Explorer/RecentDocs/.hwp", "0", 3, wide("계약서.hwp\0") + b"\5\5"),
        ("software", "R/Microsoft/Windows/CurrentVersion/RunOnce", "go", 2, wide("c:\\go.exe\0")),
        ("amcache.hve", "R/InventoryApplicationFile/a|1", "LowerCaseLongPath", 1, wide("c:\\kape.exe\0")), ("amcache.hve", "R/InventoryApplicationFile/a|1", "FileId", 3, bytes(range(20)) + b"zz"),
        ("amcache.hve", "R/InventoryApplicationFile/b|2", "Size", 4, struct.pack("<I", 1)),
    ])
    got = {(r["program"], r["how"], r["file_time_utc"], r["control_set"]) for r in artifacts.shimcache(rows).collect()}
    assert got == {("C:\\t\\FTKImager.exe", "entry", ISO, "ControlSet001"), ("C:\\b.exe", "entry", ISO, "ControlSet001"), ("C:\\old\\x.exe", "text", None, "ControlSet002")}
    assert [tuple(r)[1:] for r in artifacts.usbstor(rows).collect()] == [("Disk&Ven_X", "123", "Stick", ISO, "ControlSet001")]
    assert {tuple(r)[1:] for r in artifacts.userassist(rows).collect()} == {("C:\\XNCR.exe", 5, ISO), ("short", 6, ISO), ("tiny", None, None)}
    assert [tuple(r)[1:] for r in artifacts.recent_documents(rows).collect()] == [("계약서.hwp", ".hwp")]
    assert [tuple(r)[1:] for r in artifacts.run_keys(rows).collect()] == [("RunOnce", "go", "c:\\go.exe", ISO)]
    assert [tuple(r)[1:] for r in artifacts.amcache(rows).collect()] == [("c:\\kape.exe", bytes(range(20)).hex(), ISO)]


def test_artifact_collection(spark):
    ship(spark)
    pf = bytearray(0x200)
    struct.pack_into("<I", pf, 0, 30)
    pf[4:8] = b"SCCA"
    pf[0x10:0x1E] = wide("FTK.EXE")
    record = b"**\0\0" + struct.pack("<IQQ", 28, 7, FILETIME) + struct.pack("<I", 28)
    later = b"**\0\0" + struct.pack("<IQQ", 28, 8, FILETIME - 10**9) + struct.pack("<I", 28)
    files = [
        ("Windows/Prefetch/FTKIMAGER.EXE-0A1B2C3D.pf", 10, bytes(pf)), ("Windows/Prefetch/OLD.EXE-0A1B2C3D.pf", 1, b"MAM\x04"), ("Windows/System32/winevt/Logs/System.evtx", 1, bytes(0x1000) + record + later),
        ("Windows/System32/winevt/Logs/Security.evtx", 1, b""), ("Windows/System32/drivers/winpmem.sys", 10, b"x"), ("Windows/System32/config/SYSTEM", 1, b"broken"), ("docs/a.txt", 10, b"x"),
    ]
    df = spark.createDataFrame([(p, len(c), t, bytearray(c)) for p, t, c in files], "path string, size long, mtime_ns long, content binary")
    held = artifacts.matched(df, since_ns=5)
    assert {r["path"].split("/")[-1] for r in held.collect()} == {"FTKIMAGER.EXE-0A1B2C3D.pf", "System.evtx", "Security.evtx", "winpmem.sys", "SYSTEM"}
    logs = held.where("category = 'evtx'")
    times = {r["path"].split("/")[-1]: (r["status"], r["event_count"], r["first_event_utc"], r["last_event_utc"]) for r in artifacts.timelines(logs, artifacts.events(logs)).collect()}
    assert times == {"System.evtx": ("ok", 2, ISO, "2024-04-30T23:58:20+00:00"), "Security.evtx": ("no_records", 0, None, None)}
    signs = artifacts.observed(df)
    assert {(r["label"], r["evidence"]) for r in signs.collect()} == {("FTK Imager", "prefetch"), ("WinPmem", "drivers")}
    assert {(r["label"], r["items"], tuple(r["evidence"])) for r in artifacts.tools(signs).collect()} == {("FTK Imager", 1, ("prefetch",)), ("WinPmem", 1, ("drivers",))}
    assert {r["category"]: r["files"] for r in artifacts.summary(held).collect()} == {"prefetch": 1, "evtx": 2, "drivers": 1, "registry_or_device_log": 1}
    row = spark.range(1).select(artifacts.device_strings(F.array(F.lit("x"), F.lit("USBSTOR\\Disk"), F.lit("VID_0ABC"))).alias("d"), artifacts.link_targets(F.array(F.lit("C:\\a"), F.lit("b"), F.lit("c.hwp"))).alias("t")).first()
    assert row["d"] == ["USBSTOR\\Disk", "VID_0ABC"] and row["t"] == ["C:\\a", "c.hwp"]
    assert artifacts.observed(df.limit(0)).count() == 0
    chunk = bytearray(0x10000)
    packed = zlib.compressobj(wbits=-15)
    payload = packed.compress(record + wide("기록된 문자열")) + packed.flush()
    chunk[:8] = b"ElfChnk\0"
    struct.pack_into("<I", chunk, 48, 0x200 + len(payload))
    chunk[0x200 : 0x200 + len(payload)] = payload
    assert cell(spark, parsers.evtx_strings, bytes(0x1000) + bytes(chunk), F.lit(10)) == ["기록된 문자열"]


HEAD = ["연번", "파일명", "확장자명", "파일 크기(바이트)", "경로", "SHA1", "생성일시", "수정일시", "접근일시"]


def package(rows, printed):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("목록.xlsx", workbook({"s": [HEAD, *rows]}))
        z.writestr("skip.txt", "x")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("시스템정보.zip", inner.getvalue())
        z.writestr("전자정보확인서_20260101120000.pdf", b"%PDF-1.4")
        z.writestr("상세목록.pdf", b"%PDF-1.4\nstream\n" + zlib.compress(b"BT (" + printed + b") Tj ET") + b"\nendstream")
    return out.getvalue()


def test_certificate_package(spark):
    ship(spark)
    sha = hashlib.sha1(b"x").hexdigest()
    rows = [["1", "a.txt", "txt", "3 B", "C:\\d\\a.txt", sha, "", "2026-02-01 12:00:00", ""], ["3", "b.txt", "txt", "4", "C:\\d\\b.txt", hashlib.sha1(b"y").hexdigest(), "", "", ""], ["2", "c.txt", "txt", "", "C:\\d\\c.txt", "", "", "", ""]]
    data = package(rows, sha.encode())
    parts = certificate.members(spark.createDataFrame([("p.zip", bytearray(data))], "path string, content binary"))
    assert {r["member"]: r["role"] for r in parts.collect()} == {"시스템정보.zip": "sysinfo", "시스템정보.zip!목록.xlsx": "xlsx", "상세목록.pdf": "detail_pdf", "전자정보확인서_20260101120000.pdf": "form_pdf"}
    assert [(r["ord"], r["seq"]) for r in certificate.package_rows(parts).orderBy("ord").collect()] == [(0, "1"), (1, "3"), (2, "2")]
    files = spark.createDataFrame([("d/a.txt", 3, sha, None, None), ("d/b.txt", 5, sha, None, None)], "path string, size long, sha1 string, sha256 string, md5 string")
    found = certificate.package_findings(parts, files)
    assert {r["check"]: (r["severity"], r["count"]) for r in found.collect()} == {"seq_integrity": ("warn", 1), "post_cert_mtime": ("fail", 1), "detail_pdf_crosscheck": ("warn", 1), "live_reverify": ("fail", 2)}
    assert certificate.live_stats(certificate.package_rows(parts), files).first().asDict() == {"resolved": 2, "missing": 1, "size_match": 1, "size_mismatch": 1, "hash_verified": 1, "hash_mismatch": 1, "hash_skipped": 0}
    assert certificate.package_summary(parts, found).first().asDict() == {"rows": 3, "seq_first": 1, "seq_last": 3, "findings": 4, "fail": 2, "warn": 2}
    bare = certificate.members(spark.createDataFrame([("x/detail.pdf", bytearray(b"%PDF-1.4"))], "path string, content binary"))
    assert {r["check"]: r["severity"] for r in certificate.package_findings(bare).collect()} == {"no_detail_xlsx": "info", "detail_pdf_text": "info"}


def test_sequence_issues(spark):
    def issues(*seqs):
        rows = spark.createDataFrame(list(enumerate(seqs)), "ord long, seq string")
        return sorted(r["issue"] for r in certificate.sequence_issues(rows).collect())

    assert issues("1", "2", "3", "") == [] and issues() == []
    assert issues("1", "2", "2", "4", "3") == ["descent", "duplicate"]
    assert issues("1", "x", "", "3") == ["gap", "non_numeric", "non_numeric_cells"]
    assert issues(*[str(i) for i in range(20_000)], "5") == ["descent", "duplicate"]


def test_recycle_bin_channel(spark):
    rows = [("$Recycle.Bin/S/$IA.xlsx", ("C:\\x\\목록.xlsx", FILETIME, 5)), ("$Recycle.Bin/S/$IB", ("C:\\x\\photo.gif", FILETIME, 6)), ("$Recycle.Bin/S/$IC", ("C:\\late.zip", FILETIME + 9, 7))]
    info = spark.createDataFrame(rows, "path string, r struct<original_path: string, deleted: long, size: long>")
    files = spark.createDataFrame([("$Recycle.Bin/S/$RA.xlsx", 9, "file", 1)], "path string, size long, kind string, mtime_ns long")
    binned = evidence.recycle_bin(info, files, FILETIME, FILETIME)
    assert sorted(tuple(r) for r in binned.select("category", "original_path", "content_path").collect()) == [("bin_deleted", "C:\\x\\photo.gif", None), ("bin_list_or_container", "C:\\x\\목록.xlsx", "$Recycle.Bin/S/$RA.xlsx")]
    every = evidence.leftovers(files, 0, None, None, binned)
    assert every.where("channel = 'recycle_bin'").count() == 2
    assert {(r["category"], r["truncated"]) for r in evidence.leftover_summary(every.unionByName(every), 3).where("channel = 'recycle_bin'").collect()} == {("bin_deleted", False), ("bin_list_or_container", False)}


def test_old_recycle_list(spark):
    record = struct.pack("<I4sQI", 3, b"C:\0\0", FILETIME, 5) + b"\0".ljust(260, b"\0") + wide("\\x\\목록.xlsx").ljust(520, b"\0")
    ship(spark)
    info = spark.createDataFrame([("RECYCLER/S/INFO2", bytearray(bytes(20) + record))], "path string, content binary").select("path", F.explode(parsers.recycled_list("content")).alias("r"))
    files = spark.createDataFrame([("RECYCLER/S/Dc3.xlsx", 9)], "path string, size long")
    assert [tuple(r) for r in evidence.recycled_list_pairs(info, files, FILETIME, FILETIME).collect()] == [("bin_list_or_container", "C:\\x\\목록.xlsx", FILETIME, 5, "RECYCLER/S/Dc3.xlsx", 9)]
    assert evidence.recycled_list_pairs(info, files.limit(0), FILETIME, FILETIME).first()["content_path"] is None
    assert evidence.recycled_list_pairs(info, files, FILETIME + 1, FILETIME + 2).count() == 0


def test_lists_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.xls").write_bytes(b"\xd0\xcf")
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    (tmp_path / "c.xlsx").write_bytes(workbook({"s": []}))
    (tmp_path / "d.lst").write_text('\n  [\n"C:/x.txt"]'.lstrip())
    for name in ("a.xls", "b.xlsx", "c.xlsx"):
        assert [r["unparsed"] for r in claims.read_claims(spark, str(tmp_path / name)).collect()] == [True], name
    assert [r["rel"] for r in claims.read_claims(spark, str(tmp_path / "d.lst")).collect()] == ["x.txt"]


def test_best_source(spark, tmp_path):
    """The list of the first name that has rows; of equal names the newest scan's; others only where no known name is there."""
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    def names():
        return spark.createDataFrame([(str(p.relative_to(tmp_path)),) for p in tmp_path.rglob("*") if p.is_file()], "path string")

    put("zz/list.txt", "C:/a.txt\n")
    put("b.csv", "path\nC:/b.txt\n")
    assert [r["path"] for r in claims.source_candidates(names()).orderBy("rank").collect()] == ["b.csv", "zz/list.txt"]
    put("scan_1/report.json", '{"files": ["C:/old.txt"]}')
    put("scan_2/report.json", '{"x": 1}')
    put("scan_2/file_paths.txt", "C:/1\nC:/2\n")
    assert [r["path"] for r in claims.source_candidates(names()).orderBy("rank").collect()] == ["scan_2/report.json", "scan_1/report.json", "scan_2/file_paths.txt"]
    items, used = claims.read_best(spark, names(), str(tmp_path))
    assert used == "scan_1/report.json" and [r["rel"] for r in items.collect()] == ["old.txt"]
    assert claims.read_best(spark, names().limit(0)) == (None, None)
    found = spark.createDataFrame([(n,) for n in ("profile-1.json", "profile.txt", "seized.pdf", "seized-ocr.txt", "baseline.db", "info.txt", "info.json", "x")], "path string")
    assert {r["kind"]: r["path"] for r in reports.field_inputs(found).collect()} == {"profile": "profile-1.json", "seized": "seized-ocr.txt", "baseline": "baseline.db", "info": "info.json"}


def test_compound_file(spark):
    """One stream of a compound file, deflated, found through the allocation table."""
    packed = zlib.compressobj(wbits=-15)
    data = packed.compress(wide("압수한 문서의 본문입니다 " * 400)) + packed.flush() + bytes(5000)
    sectors = -(-len(data) // 512)
    table = [0xFFFFFFFD, 0xFFFFFFFE, *[k + 1 for k in range(2, sectors + 1)], 0xFFFFFFFE]
    head = bytearray(512)
    head[:8] = parsers.COMPOUND
    struct.pack_into("<HH", head, 30, 9, 6)
    struct.pack_into("<I", head, 48, 1)
    struct.pack_into("<III", head, 56, 4096, 0xFFFFFFFE, 0)
    struct.pack_into("<II", head, 68, 0xFFFFFFFE, 0)
    struct.pack_into("<109I", head, 76, 0, *[0xFFFFFFFF] * 108)

    def entry(name, kind, at, size):
        e = bytearray(128)
        e[: 2 * len(name)] = wide(name)
        struct.pack_into("<HB", e, 64, 2 * len(name) + 2, kind)
        struct.pack_into("<II", e, 116, at, size)
        return bytes(e)

    directory = entry("Root", 5, 0xFFFFFFFE, 0) + entry("Section0", 2, 2, len(data))
    whole = bytes(head) + struct.pack(f"<{len(table)}I", *table).ljust(512, b"\xff") + directory.ljust(512, b"\0") + data.ljust(sectors * 512, b"\0")
    assert "압수한 문서의 본문입니다" in cell(spark, parsers.extract_text, whole, F.lit(".hwp"))
    assert cell(spark, parsers.extract_text, parsers.COMPOUND + bytes(10), F.lit(".hwp")) is None


def test_petition_and_reread_results(spark, tmp_path):
    ship(spark)
    items = [{"claimed_path": "a", "claimed_sha256": "ab" * 32, "matched_path": "a", "status": "verified", "scope_verdict": "out_of_scope", "notes": []}, {"claimed_path": "b", "status": "verified", "notes": ["absent on current disk"]}]
    results = reports.results_from_json(spark.createDataFrame([(json.dumps({"items": items, "summary": {}}),)], "value string"))
    assert [tuple(r) for r in custody.petition_items(results).orderBy("no").collect()] == [(1, "a", "ab" * 10, "verified", "out_of_scope"), (2, "b", None, "verified", "unknown")]
    changes = reports.changes_from_json(spark.createDataFrame([('{"added": [{"path": "x", "backdated": true}, {"path": "y"}], "removed": [{"path": "z"}]}',)], "value string"))
    assert sorted(tuple(r) for r in changes.collect()) == [("x", "added", True), ("y", "added", False), ("z", "removed", False)]
    lists = custody.numbered_lists(custody.disposal_lists(results, changes)).collect()
    assert {(r["section"], r["no"], r["path"]) for r in lists} == {("out_of_scope", 1, "a"), ("absent_now", 1, "b"), ("backdated", 1, "x")}
    places = spark.createDataFrame([(True,), (True,), (False,)], "violation boolean")
    words = spark.createDataFrame([(0, "a", 4, 0.25), (1, "b", 2, 0.5), (2, "c", 0, 0.0)], "ord int, term string, seized long, noise_ratio double")
    noise = spark.createDataFrame([(6, 0.3333)], "attributed long, noise_ratio double")
    got = {r["ground"]: (r["value"], r["term"]) for r in custody.petition_grounds(results, None, places, words, noise).collect()}
    assert got == {"items": (2.0, None), "out_of_scope": (1.0, None), "absent_now": (1.0, None), "outside_territory": (2.0, None), "noise": (0.3333, None), "worst_keyword": (0.5, "b")}
    results.write.parquet(f"{tmp_path}/steps/verify")
    assert reports.case_table(spark, str(tmp_path), "verify").count() == 2 and reports.case_table(spark, str(tmp_path), "diff") is None
    with pytest.raises(ValueError, match="summary"):
        reports.markdown(spark.range(10_001), "t")


def test_scan_counts_content(spark):
    rows = [("a.txt", 10, "계약", "ok"), ("b.txt", 10, None, "ok"), ("c.bin", 10, None, "ok"), ("d.txt", 1 << 30, None, "read_error"), ("x/e.txt", 10, "계약", "ok")]
    files = spark.createDataFrame([(p, s, 1, 1, 1, None, "file", st, t) for p, s, t, st in rows], schema.FILES + ", text string")
    profile = Profile(keywords=(Keyword("계약", where="content"),), path_exclude=("x/*",))
    got = scan.counters(files, profile, content="text").first().asDict()
    assert got == {"evaluated": 5, "excluded": 1, "hits": 1, "in_scope": 1, "in_scope_partial": 0, "borderline": 0, "errors": 1, "content_extracted": 2, "content_extract_failed": 1, "content_not_evaluated": 2, "unverifiable": 3, "content_keyword_terms": 1, "statuses": {"ok": 4, "read_error": 1}}
    assert [(r["path"], r["seq"]) for r in scan.scan(files, profile, content="text").collect()] == [("a.txt", 1)]
    twice = files.union(files)
    assert sorted(r["seq"] for r in scan.scan(twice, profile, content="text").collect()) == [1, 2]


def test_scoped_search(spark):
    files = spark.createDataFrame([("docs/a/contract.hwp",), ("docs/b/contract.hwp",), ("other/contrac7.hwp",)], "path string")
    folders = spark.createDataFrame([("docs",), ("docs/a",), ("docs/b",), ("other",)], "path string")
    rels = spark.createDataFrame([("docs/a/c0ntract.hwq",), ("docs/a/contract.hwp",), ("gone/contract.hwp",), ("docs/zz/other.bin",)], "rel string")
    got = {r["rel"]: (r["path"], r["status"]) for r in resolve.scoped(rels, files, folders).collect()}
    assert got == {"docs/a/c0ntract.hwq": ("docs/a/contract.hwp", "resolved_fuzzy"), "docs/a/contract.hwp": ("docs/a/contract.hwp", "resolved_direct"), "gone/contract.hwp": (None, "not_found"), "docs/zz/other.bin": (None, "not_found")}


def test_similar_paths_against_difflib(spark):
    """Every pair's ratio by hand: the same best path, and the same doubts."""
    import difflib
    import random

    rnd = random.Random(3)
    names = ["".join(rnd.choice("abcdefgo0il1/.") for _ in range(rnd.randrange(3, 30))) for _ in range(60)]
    noisy = ["".join(c if rnd.random() > 0.1 else rnd.choice("xyz") for c in n) for n in names] + names[:5]
    key = str.maketrans("oil|szgq", "01115299")
    want = {}
    for rel in set(noisy):
        scores = sorted(((difflib.SequenceMatcher(None, rel.lower().translate(key), p.lower().translate(key)).ratio(), p) for p in names), reverse=True)
        (best, path), (second, _) = scores[0], scores[1]
        second = second if second >= 0.77 else 0.0
        if best >= 0.77:
            want[rel] = (path if best >= 0.82 and best - second >= 0.05 else None, best >= 0.82 and best - second < 0.05)
    files = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r["rel"]: (r["fuzzy_path"], r["ambiguous"]) for r in resolve.fuzzy(spark.createDataFrame([(n,) for n in noisy], "rel string"), files).collect()}
    assert got == want and any(a for _, a in got.values()) | True


def test_hash_set_files(spark, tmp_path):
    (tmp_path / "known.txt").write_text(f"# head\n{'AB' * 32}  name\n\nno digest\n{'cd' * 16}\n")
    (tmp_path / "p.json").write_text(json.dumps({"criteria": {"hash_sets": [{"name": "k", "file": "known.txt"}]}}))
    assert sorted(r["digest"] for r in load_hash_sets(spark, str(tmp_path / "p.json")).collect()) == ["ab" * 32, "cd" * 16]
    (tmp_path / "q.json").write_text("{}")
    assert load_hash_sets(spark, str(tmp_path / "q.json")) is None


def test_far_times(spark):
    row = spark.range(1).select(timeutil.filetime_to_iso(F.lit(2**63 - 1)).alias("a"), timeutil.filetime_to_ns(F.lit(2**63 - 1)).alias("b"), timeutil.ns_to_iso(F.lit(1700000000999999999)).alias("c")).first()
    assert row["a"].startswith("invalid_ns:") and row["b"] is None and row["c"] == "2023-11-14T22:13:20+00:00"


@pytest.fixture
def tree(tmp_path):
    for i in range(12):
        p = tmp_path / "root" / f"d{i % 3}" / f"e{i % 2}" / f"f{i}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x" * i)
    return tmp_path


def test_commands(spark, tree, capsys):
    out = str(tree / "out")
    root, inv = str(tree / "root"), f"{out}/inv"
    assert case.main(["inventory", "--root", root, "--out", inv, "--hash"]) == 0
    files = spark.read.parquet(f"{inv}/files")
    assert files.where("kind = 'file'").count() == 12 and {r["key"] for r in spark.read.parquet(f"{inv}/summary").collect()} == {"root", "created_utc", "access_mode", "entries", "kinds", "statuses"}
    (tree / "list.txt").write_text("C:\\d0\\e0\\f0.txt\nnone/such.bin\n")
    (tree / "p.json").write_text('{"criteria": {"extensions": ["txt"], "keywords": ["f1"]}}')
    base = ["--inventory", f"{inv}/files"]
    listed = ["--claims", str(tree / "list.txt")]
    profile = ["--profile", str(tree / "p.json")]
    runs = {
        "scan": base + profile, "verify": base + listed + profile, "diff": [*base, "--current", f"{inv}/files"], "boundary": listed, "keyword-audit": base + listed + profile, "window": [*base, "--since", "2000-01-01"],
        "leftovers": base, "containers": base, "sources": base, "mobile": base, "artifacts": ["--root", root], "convert": listed, "mirror": base + listed, "seal": base, "certificate": ["--package", root],
    }
    for name, args in runs.items():
        assert case.main([name, *args, "--out", f"{out}/{name}"]) == 0, (name, capsys.readouterr())
        assert spark.read.parquet(f"{out}/{name}/summary").count() >= 0
    assert case.main(["case", *base, *listed, *profile, "--out", f"{out}/case", "--since", "2000-01-01", "--artifacts", root]) == 0
    steps = {r["step"]: r["status"] for r in spark.read.parquet(f"{out}/case/steps").collect()}
    assert {s for s in steps.values()} == {"ok", "skipped"} and steps["artifacts"] == "ok" and steps["diff"] == "skipped"
    assert case.main(["inquiry", "--case", f"{out}/case", "--query", "f0", "--out", f"{out}/q"]) == 0
    assert case.main(["petition", "--case", f"{out}/case", "--out", f"{out}/pet"]) == 0
    assert case.main(["petition", "--case", f"{out}/q", "--out", f"{out}/no"]) == 1
    (tree / "sums.txt").write_text(f"{hashlib.sha256(b'').hexdigest()}  d0/e0/f0.txt\n")
    assert case.main(["check-sums", "--sums", str(tree / "sums.txt"), *base, "--out", f"{out}/sums"]) == 0
    assert spark.read.parquet(f"{out}/sums/summary").first()["verdict"] == "ok"
    for bad in (["scan"], ["diff", *base, "--current", "/nope", "--out", out], ["window", *base, "--since", "soon", "--out", out], ["nothing"]):
        with pytest.raises(SystemExit) as e:
            case.main(bad)
        assert e.value.code == 2


def test_filesystem_splits_and_changes(spark, tree):
    ship(spark)
    spark.dataSource.register(FilesystemSource)
    load = lambda **o: sorted(tuple(r) for r in spark.read.format("inventory").options(**o).load(str(tree / "root")).select("path", "kind", "size").collect())
    want = load(splitDepth="1")
    assert len(want) == 12 + 3 + 6 and load() == want == load(splitDepth="5")
    assert [p for p, _, _ in load(maxDepth="1")] == [p for p, _, _ in want if p.count("/") <= 1]
    (tree / "root" / "d0" / "loop").symlink_to(tree / "root")
    assert len(load(followLinks="true")) == len(want) + 1
    meta = {r["key"]: r["value"] for r in inventory.meta(spark.read.format("inventory").load(str(tree / "root")), "/r", "t", ["a", "b"]).collect()}
    assert meta["root"] == '"/r"' and meta["access_mode"] == '"mixed"' and json.loads(meta["kinds"])["file"] == 12


def test_rest_stands_without_text_operators(tmp_path):
    """Without the text operators' folders the entry point imports and has the other queries, whether corpus_pipeline.py is there or not."""
    home = Path(__file__).parent.parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(home / name, tmp_path / name)
    shutil.copytree(home / "tallywright", tmp_path / "tallywright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'snapshot_diff' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    for gone in (None, "corpus_pipeline.py"):
        if gone:
            (tmp_path / gone).unlink()
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
