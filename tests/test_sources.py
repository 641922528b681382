"""Readers: filesystem, claim lists, journals, binary formats. Inputs are built here."""

import hashlib
import io
import os
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tallywright.operators import certificate, custody, inventory
from tallywright.session import ship
from tallywright.sources import claims, parsers
from tallywright.sources.filesystem import FilesystemSource

FILETIME = 133589952000000000


def cell(spark, column, data, *more):
    ship(spark)
    return spark.createDataFrame([(bytearray(data),)], "content binary").select(column("content", *more).alias("x")).first()["x"]


@pytest.fixture
def tree(tmp_path):
    for name, text in {"docs/계약서.hwp": "a", "docs/.hidden": "b", "_x/notes.txt": "c", "top.txt": "d"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path, tmp_path / "docs/loop")
    return tmp_path


def test_filesystem(spark, tree):
    ship(spark)
    spark.dataSource.register(FilesystemSource)
    rows = {r["path"]: r for r in spark.read.format("inventory").option("hashFiles", "true").load(str(tree)).collect()}
    assert set(rows) == {"docs", "docs/계약서.hwp", "docs/.hidden", "docs/loop", "_x", "_x/notes.txt", "top.txt", "empty"}
    assert rows["docs/loop"]["kind"] == "symlink" and rows["empty"]["kind"] == "dir"
    assert rows["top.txt"]["sha256"] == hashlib.sha256(b"d").hexdigest() and rows["docs"]["sha256"] is None
    assert rows["top.txt"]["mtime_ns"] == os.stat(tree / "top.txt").st_mtime_ns
    small = spark.read.format("inventory").option("hashFiles", "true").option("maxHashBytes", "0").load(str(tree)).where("kind = 'file'")
    assert {r["status"] for r in small.collect()} == {"hash_skipped_oversize"}
    missing = spark.read.format("inventory").load(str(tree / "nothing")).collect()
    assert [(r["path"], r["kind"]) for r in missing] == [(".", "error")]


def test_walk_order(spark):
    names = ["b/x", "a", "b", "c", "b/a/z", "b/a"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r["path"] for r in df.orderBy(*inventory.walk_order(F.col("path"))).collect()] == ["a", "b", "c", "b/a", "b/x", "b/a/z"]


def test_text_list(spark, tmp_path):
    p = tmp_path / "list.txt"
    p.write_text(f"# head\n\nC:\\docs\\a.hwp\n{'ab' * 32}  docs/b.txt\n1 | x | C:\\d\\c.pdf\n")
    got = [(r["rel"], r["digest"], r["hash_algo"]) for r in claims.read_claims(spark, str(p)).orderBy("ord").collect()]
    assert got == [("docs/a.hwp", None, None), ("docs/b.txt", "ab" * 32, "sha256"), ("d/c.pdf", None, None)]
    (tmp_path / "none.txt").write_text("")
    assert claims.read_claims(spark, str(tmp_path / "none.txt")).count() == 0


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"Path,SHA256\nC:\\docs\\a.hwp,{'aa' * 32}\n,{'bb' * 32}\n")
    got = [(r["rel"], r["unparsed"]) for r in claims.read_claims(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()]
    assert got == [("docs/a.hwp", False), (None, True)]
    (tmp_path / "a.json").write_text('{"scan_config": {}, "likely_seized_files": ["C:\\\\a.txt", {"path": "", "name": "b.txt", "md5": "' + "cc" * 16 + '"}, 7]}')
    got = [(r["rel"], r["hash_algo"], r["unparsed"]) for r in claims.read_claims(spark, str(tmp_path / "a.json")).orderBy("ord").collect()]
    assert got == [("a.txt", None, False), ("b.txt", "md5", False), (None, None, True)]
    (tmp_path / "b.json").write_text('{"x": 1}')
    assert [r["unparsed"] for r in claims.read_claims(spark, str(tmp_path / "b.json")).collect()] == [True]


def workbook(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</R>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{k}">' + "".join(f'<c r="{chr(65 + c)}{k}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v) + "</row>" for k, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook_and_certificate(spark, tmp_path):
    head = ["연번", "파일명", "확장자명", "파일 크기(바이트)", "경로", "SHA1", "생성일시", "수정일시", "접근일시"]
    sha = hashlib.sha1(b"x").hexdigest()
    rows = [head, ["1", "a.txt", "txt", "3", "C:\\d\\a.txt", sha, "2025-01-01", "2025-01-01", ""], ["2", "b.txt", "txt", "3", "C:\\d\\c.txt", sha, "", "2026-02-01 12:00:00", ""], ["4", "d.txt", "txt", "", "C:\\d\\d.txt", "NOT-HEX", "xx", "", ""]]
    data = workbook({"표지": [["압수목록"]], "목록": rows})
    got = cell(spark, parsers.read_xlsx, data)
    assert [(r["seq"], r["sheet"], r["row"]) for r in got if r["seq"]] == [("1", "목록", 2), ("2", "목록", 3), ("4", "목록", 4)]
    assert cell(spark, parsers.read_xlsx, b"not a zip") is None
    (tmp_path / "l.xlsx").write_bytes(data)
    assert [r["rel"] for r in claims.read_claims(spark, str(tmp_path / "l.xlsx")).where("hash_algo = 'sha1'").orderBy("ord").collect()] == ["d/a.txt", "d/c.txt"]
    cert = spark.createDataFrame([r for r in got if r["seq"]]).withColumn("ord", F.col("row"))
    found = {r["check"]: r["count"] for r in certificate.findings(cert, certificate.issued_at(F.lit("증명서_20260101120000.pdf"))).collect()}
    assert found == {"seq_integrity": 1, "hash_format": 1, "name_path_mismatch": 1, "duplicate_sha1": 1, "post_cert_mtime": 1, "unparseable_date": 1}
    files = spark.createDataFrame([("d/a.txt", 3, sha, None, None)], "path string, size long, sha1 string, sha256 string, md5 string")
    assert {r["ord"]: r["result"] for r in certificate.reverify(cert, files).collect()} == {2: "match", 3: "missing", 4: "missing"}


def test_text_extraction(spark):
    pdf = b"%PDF-1.4\nstream\n" + zlib.compress(b"BT (Hello \\(x\\)) Tj [(A) 3 (B)] TJ ET") + b"\nendstream"
    assert cell(spark, parsers.extract_text, pdf, F.lit(".pdf")) == "Hello (x)\nAB"
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", "<w><t>계약</t></w>")
    assert "계약" in cell(spark, parsers.extract_text, docx.getvalue(), F.lit(".docx"))
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.docx", docx.getvalue())
        z.writestr("a.txt", "안녕".encode("cp949"))
    got = cell(spark, parsers.extract_text, outer.getvalue(), F.lit(".zip"))
    assert "계약" in got and "안녕" in got
    assert cell(spark, parsers.extract_text, b"\0\1", F.lit(".bin")) is None
    assert cell(spark, parsers.strings, b"\0abcdefg\0\0\0" + "한글문자열입니다".encode("utf-16-le"), F.lit(10)) == ["abcdefg", "한글문자열입니다"]


def mft_record(deleted=False, stomped=False):
    b = bytearray(1024)
    b[:4] = b"FILE"
    struct.pack_into("<HH", b, 4, 0x30, 3)
    struct.pack_into("<HH", b, 0x14, 0x38, 0 if deleted else 1)
    at = 0x38
    name = "비밀.txt".encode("utf-16-le")
    si = struct.pack("<QQQQ", FILETIME, FILETIME + (50_000_000 if stomped else 0), 0, 0)
    fn = struct.pack("<QQQQQQQ", 5, FILETIME, FILETIME, 0, 0, 0, 77) + bytes(8) + bytes([len(name) // 2, 1]) + name
    for kind, content in ((0x10, si), (0x30, fn), (0x80, b"payload")):
        size = (24 + len(content) + 7) // 8 * 8
        struct.pack_into("<II", b, at, kind, size)
        struct.pack_into("<IH", b, at + 0x10, len(content), 24)
        b[at + 24 : at + 24 + len(content)] = content
        at += size
    struct.pack_into("<I", b, at, 0xFFFFFFFF)
    b[0x30:0x32] = b"\7\7"
    for k, end in ((1, 510), (2, 1022)):
        b[0x30 + 2 * k : 0x32 + 2 * k] = b[end : end + 2]
        b[end : end + 2] = b"\7\7"
    return bytes(b)


def test_mft(spark):
    ship(spark)
    damaged = bytearray(mft_record())
    damaged[510:512] = b"\0\0"
    dump = mft_record() + mft_record(deleted=True, stomped=True) + bytes(1024) + bytes(damaged)
    df = spark.createDataFrame([(bytearray(dump),)], "content binary").select(F.explode(parsers.mft_records(F.col("content"))).alias("r"))
    rows = df.select(parsers.mft_record("r.record", "r.index").alias("x")).where("x IS NOT NULL").select("x.*")
    got = {r["index"]: r for r in rows.collect()}
    assert set(got) == {0, 1, 3}
    assert got[0]["name"] == "비밀.txt" and got[0]["si_fn_mismatch"] is False and got[0]["parent_ref"] == 5 and bytes(got[0]["payload"]) == b"payload"
    assert got[1]["deleted"] and got[1]["si_fn_mismatch"] is True
    assert got[3]["parse_error"] and got[3]["name"] is None
    assert [r["sha256"] for r in parsers.carvable(rows).collect()] == [hashlib.sha256(b"payload").hexdigest()]


def test_event_log(spark):
    body = "USB 장치 연결됨 확인".encode("utf-16-le") + b"\0\0"
    size = 24 + len(body) + 4
    record = b"**\0\0" + struct.pack("<IQQ", size, 7, FILETIME) + body + struct.pack("<I", size)
    broken = record[:-4] + struct.pack("<I", 1)
    packed = zlib.compressobj(wbits=-15)
    payload = packed.compress(record + broken) + packed.flush()
    chunk = bytearray(0x10000)
    chunk[:8] = b"ElfChnk\0"
    struct.pack_into("<I", chunk, 48, 0x200 + len(payload))
    chunk[0x200 : 0x200 + len(payload)] = payload
    got = cell(spark, parsers.evtx_events, bytes(0x1000) + bytes(chunk), F.lit(6))
    assert [(r["record_id"], r["filetime"]) for r in got] == [(7, FILETIME)]
    assert cell(spark, parsers.evtx_events, b"", F.lit(6)) == []


def test_prefetch_and_recycled(spark):
    b = bytearray(0x200)
    struct.pack_into("<I", b, 0, 30)
    b[4:8] = b"SCCA"
    b[0x10 : 0x10 + 16] = "FTK.EXE\0".encode("utf-16-le")
    struct.pack_into("<Q", b, 0x80, FILETIME)
    struct.pack_into("<I", b, 0xD0, 9)
    got = cell(spark, parsers.prefetch, bytes(b))
    assert (got["exe"], got["run_count"], got["last_runs"]) == ("FTK.EXE", 9, [FILETIME])
    assert cell(spark, parsers.prefetch, b"MAM\x04xxxx")["status"] == "compressed_unparsed"
    name = "C:\\a\\목록.xlsx\0"
    v2 = struct.pack("<QQQI", 2, 10, FILETIME, len(name)) + name.encode("utf-16-le")
    assert cell(spark, parsers.recycled, v2)["original_path"] == "C:\\a\\목록.xlsx"
    assert cell(spark, parsers.recycled, struct.pack("<QQQ", 1, 10, FILETIME) + "C:\\b".encode("utf-16-le").ljust(520, b"\0"))["original_path"] == "C:\\b"
    record = struct.pack("<I4sQI", 3, b"C\0\0\0", FILETIME, 5) + b"C:\\x.txt".ljust(260, b"\0") + "C:\\x.txt".encode("utf-16-le").ljust(520, b"\0")
    got = cell(spark, parsers.recycled_list, bytes(20) + record)
    assert [(r["record"], r["drive"], r["deleted"], r["size"], r["original_path"]) for r in got] == [(3, "C", FILETIME, 5, "C:\\x.txt")]
    assert cell(spark, parsers.recycled, b"\0") is None


def test_link(spark):
    b = bytearray(0x4C)
    struct.pack_into("<I", b, 0, 0x4C)
    b[4:20] = bytes.fromhex("0114020000000000c000000000000046")
    struct.pack_into("<I", b, 0x14, 2 | 0x80)
    info = bytearray(64)
    base = b"C:\\docs\\\0"
    tail = "목록.txt\0".encode("utf-16-le")
    struct.pack_into("<IIIIIIIII", info, 0, 64 + len(base) + len(tail), 0x24, 1, 0, 64, 0, 64, 0, 64 + len(base))
    got = cell(spark, parsers.lnk, bytes(b) + bytes(info) + base + tail)
    assert got["target"] == "C:\\docs\\목록.txt"
    assert cell(spark, parsers.lnk, b"no") is None


def test_hive(spark):
    """Two keys and a value in one bin."""
    cells = bytearray()

    def add(body):
        at = 0x20 + len(cells)
        size = (len(body) + 4 + 7) // 8 * 8
        cells.extend(struct.pack("<i", -size) + body.ljust(size - 4, b"\0"))
        return at

    data = add("F:\\usb\0".encode("utf-16-le"))
    vk = add(b"vk" + struct.pack("<HIIIHH", 4, 14, data, 1, 1, 0) + b"Name")
    values = add(struct.pack("<I", vk))

    def nk(name, n_sub, sub, n_val, val):
        b = bytearray(0x4C)
        b[:2] = b"nk"
        struct.pack_into("<HQ", b, 2, 0x20, FILETIME)
        struct.pack_into("<I", b, 0x14, n_sub)
        struct.pack_into("<I", b, 0x1C, sub)
        struct.pack_into("<II", b, 0x24, n_val, val)
        struct.pack_into("<H", b, 0x48, len(name))
        return add(bytes(b) + name)

    child = nk(b"USBSTOR", 0, 0xFFFFFFFF, 1, values)
    listing = add(b"lf" + struct.pack("<HII", 1, child, 0))
    enum = nk(b"Enum", 1, listing, 0, 0xFFFFFFFF)
    listing = add(b"lf" + struct.pack("<HII", 1, enum, 0))
    root = nk(b"ROOT", 1, listing, 0, 0xFFFFFFFF)
    head = bytearray(0x1000)
    head[:4] = b"regf"
    struct.pack_into("<I", head, 0x24, root)
    hive = bytes(head) + b"hbin" + bytes(28) + bytes(cells)
    got = cell(spark, parsers.hive_values, hive)
    assert [(r["key_path"], r["value_name"]) for r in got] == [("ROOT", None), ("ROOT/Enum", None), ("ROOT/Enum/USBSTOR", None), ("ROOT/Enum/USBSTOR", "Name")]
    assert bytes(got[-1]["data"]).decode("utf-16-le") == "F:\\usb\0"
    df = spark.createDataFrame([("ROOT/Enum/USBSTOR",)], "k string").select(parsers.hive_artifact(F.col("k")).alias("a"), parsers.rot13(F.lit("Uryyb")).alias("r"))
    assert tuple(df.first()) == ("usbstor", "Hello")
    assert cell(spark, parsers.hive_values, b"regf") in (None, [])


def test_journal_with_header(spark):
    rows = [(0, ["File name", "Reason", "Time stamp", "USN"]), (1, ["a.zip", "0x200", hex(FILETIME), "12"]), (2, ["", "0x100", hex(FILETIME), "13"])]
    got = claims.read_journal(spark.createDataFrame(rows, "ord long, cells array<string>")).collect()
    assert [tuple(r) for r in got] == [("a.zip", 0x200, "2024-05-01T00:00:00+00:00", 12)]
    assert claims.read_journal(spark.createDataFrame([], "ord long, cells array<string>")).count() == 0


def test_seal_and_parts(spark):
    sums = spark.createDataFrame([("k", "b/x", "22"), ("k", "a", "11"), ("k", "b.txt", "33")], "k string, rel string, digest string")
    assert custody.root_hash(sums, "k").first()["root"] == hashlib.sha256(b"112233").hexdigest()
    parts = spark.createDataFrame([("p1", "aa"), ("p2", "bb"), ("p3", None)], "name string, digest string")
    now = spark.createDataFrame([("p1", "AA"), ("p2", "cc"), ("p3", "dd")], "name string, digest string")
    v = custody.check_sums(parts, now)
    assert {r["name"]: r["verdict"] for r in v.collect()} == {"p1": "ok", "p2": "mismatch", "p3": "unverifiable"}
    assert custody.overall(v).first()["verdict"] == "mismatch"
