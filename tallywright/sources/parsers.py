"""Parsers of binary formats, each as an Arrow UDF from the bytes of a file (or record) to a struct or array of structs.

A file is one row, so a parser sees it whole; damaged input gives NULL fields or a row with parse_error, never an exception. Files that are
long lists of fixed records ($MFT) are cut into records first, so that they are read in parallel."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..schema import CERTIFICATE

RECORD = 1024


def parser(schema: str, arrow: pa.DataType) -> Callable:
    """Turns f(bytes, ...) into a column function; errors of damaged input give NULL."""

    def make(f: Callable) -> Callable:
        def run(*columns: pa.Array) -> pa.Array:
            out = []
            for values in zip(*(c.to_pylist() for c in columns), strict=True):
                try:
                    out.append(None if values[0] is None else f(*values))
                except (ValueError, IndexError, KeyError, struct.error, zlib.error, zipfile.BadZipFile, OSError, UnicodeError, OverflowError):
                    out.append(None)
            return pa.array(out, arrow)

        def column(*args: Column | str) -> Column:
            return arrow_udf(run, schema)(*args)  # made on use: a worker that imports this module has no session

        column.plain, column.__doc__, column.__name__ = f, f.__doc__, f.__name__
        return column

    return make


def fields(text: str) -> pa.StructType:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.struct([(name, kinds[kind]) for name, kind in (x.strip().split(" ") for x in text.split(","))])


def u16(b: bytes, at: int) -> int:
    return struct.unpack_from("<H", b, at)[0]


def u32(b: bytes, at: int) -> int:
    return struct.unpack_from("<I", b, at)[0]


def u64(b: bytes, at: int) -> int:
    return struct.unpack_from("<Q", b, at)[0]


def wide(b: bytes) -> str:
    return b.decode("utf-16-le", "replace").split("\0")[0]


# --- $MFT records

MFT = "index long, in_use boolean, deleted boolean, is_dir boolean, name string, parent_ref long, size long, si_mtime long, fn_mtime long, si_fn_mismatch boolean, resident_data_len long, payload binary, parse_error string"


def _fixed(record: bytes) -> bytes:
    """The record with its update sequence put back; ValueError if a sector doesn't carry it."""
    at, n = u16(record, 4), u16(record, 6)
    out = bytearray(record)
    for k in range(1, n):
        end = k * 512 - 2
        if out[end : end + 2] != record[at : at + 2]:
            raise ValueError("update sequence mismatch")
        out[end : end + 2] = record[at + 2 * k : at + 2 * k + 2]
    return bytes(out)


@parser(f"struct<{MFT.replace(' ', ':').replace(',:', ',')}>", fields(MFT))
def mft_record(record: bytes, index: int) -> dict | None:
    """One FILE record: names, times as FILETIME, flags and resident data; a record of another kind is NULL."""
    if record[:4] != b"FILE":
        return None
    row: dict = dict.fromkeys([x.strip().split(" ")[0] for x in MFT.split(",")]) | {"index": index, "resident_data_len": 0}
    try:
        b = _fixed(record)
    except (ValueError, struct.error) as e:
        return row | {"parse_error": str(e)}
    flags = u16(b, 0x16)
    row |= {"in_use": bool(flags & 1), "deleted": not flags & 1, "is_dir": bool(flags & 2)}
    at = u16(b, 0x14)
    while at + 16 <= len(b) and (kind := u32(b, at)) != 0xFFFFFFFF:
        size = u32(b, at + 4)
        if size < 16 or at + size > len(b):
            break
        if not b[at + 8]:
            content = b[at + u16(b, at + 0x14) :][: u32(b, at + 0x10)]
            if kind == 0x10:
                row["si_mtime"] = u64(content, 8)
            elif kind == 0x30 and (row["name"] is None or content[65] in (1, 3)):  # not the short alias, if there is another
                row |= {"name": content[66 : 66 + 2 * content[64]].decode("utf-16-le", "replace"), "parent_ref": u64(content, 0) & (2**48 - 1), "fn_mtime": u64(content, 0x10), "size": min(u64(content, 0x30), 2**63 - 1)}
            elif kind == 0x80 and not b[at + 9]:
                row |= {"payload": content, "resident_data_len": len(content), "size": len(content)}
        elif kind == 0x80 and not b[at + 9]:
            row["size"] = min(u64(b, at + 0x30), 2**63 - 1)
        at += size
    if row["si_mtime"] and row["fn_mtime"]:
        row["si_fn_mismatch"] = abs(row["si_mtime"] - row["fn_mtime"]) > 10_000_000  # more than a second
    return row


def mft_records(content: Column, size: int = RECORD) -> Column:
    """array of (index, record) of a dump; explode it and parse each record."""
    n = F.floor(F.octet_length(content) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("index"), F.substring(content, i * size + 1, F.lit(size)).alias("record")))


def carvable(rows, most: int = 4096):
    """Deleted records (MFT columns) whose content is in the record itself, with its digest and a safe name."""
    return rows.where((F.col("deleted")) & F.col("resident_data_len").between(1, most)).withColumns({"sha256": F.sha2("payload", 256), "safe_name": F.concat_ws("_", F.col("index").cast("string"), F.regexp_replace("name", r"[^\w.\-]", "_"))})


# --- event logs

EVENT = "record_id long, filetime long, strings array<string>"
_RUN8, _RUN16 = re.compile(rb"[\x20-\x7e]{6,}"), re.compile("[ -~가-힣ㄱ-ㅣ]{6,}")


def runs(data: bytes, limit: int) -> list[str]:
    """Readable runs of six characters or more, one-byte ones first, then UTF-16, each once."""
    found = [m.decode("ascii") for m in _RUN8.findall(data)]
    for shift in (0, 1):
        found += _RUN16.findall(data[shift : len(data) - (len(data) - shift) % 2].decode("utf-16-le", "replace"))
    return list(dict.fromkeys(found))[:limit]


@parser("array<string>", pa.list_(pa.string()))
def strings(content: bytes, limit: int) -> list[str]:
    return runs(content, limit)


def inflate_chunks(data: bytes) -> bytes:
    """Chunks of an event log, from 0x1000 on, whose records are deflated, put back; chunks that aren't stay as they are."""
    out = []
    for at in range(0x1000, len(data), 0x10000):
        chunk = data[at : at + 0x10000]
        if chunk[:8] != b"ElfChnk\0":
            continue
        plain = b""
        for end in (len(chunk), max(0x200, min(u32(chunk, 48), len(chunk)))):
            try:
                plain = zlib.decompressobj(-15).decompress(chunk[0x200:end])
                break
            except zlib.error:
                continue
        out.append(plain if b"**\0\0" in plain else chunk[0x200:])
    return b"".join(out) or data


@parser(f"array<struct<record_id:long,filetime:long,strings:array<string>>>", pa.list_(fields(EVENT)))
def evtx_events(content: bytes, per_record: int) -> list[dict]:
    """Records of an event log in file order: number, FILETIME, first strings. A record's size stands at both its ends."""
    data, out, at = inflate_chunks(content), [], 0
    while (at := data.find(b"**\0\0", at)) >= 0:
        size = u32(data, at + 4) if at + 8 <= len(data) else 0
        if 24 <= size <= 0x10000 and at + size <= len(data) and u32(data, at + size - 4) == size:
            out.append({"record_id": u64(data, at + 8) & (2**63 - 1), "filetime": u64(data, at + 16) & (2**63 - 1), "strings": runs(data[at + 24 : at + size - 4], per_record)})
            at += size
        else:
            at += 4
    return out


# --- links, prefetch, recycle bin

LNK = "target string, base_path string, suffix string, name string, relative_path string, working_dir string, arguments string, size long, created long, accessed long, written long"


@parser(f"struct<{LNK.replace(' ', ':').replace(',:', ',')}>", fields(LNK))
def lnk(b: bytes) -> dict | None:
    """A shell link; NULL if the header isn't one."""
    if len(b) < 0x4C or u32(b, 0) != 0x4C or b[4:20] != bytes.fromhex("0114020000000000c000000000000046"):
        return None
    flags, at = u32(b, 0x14), 0x4C
    row: dict = dict.fromkeys([x.strip().split(" ")[0] for x in LNK.split(",")]) | {"size": u32(b, 0x34), "created": u64(b, 0x1C), "accessed": u64(b, 0x24), "written": u64(b, 0x2C)}
    if flags & 1:
        at += 2 + u16(b, at)
    ansi = lambda o: b[o : b.index(b"\0", o)].decode("cp949", "replace")
    if flags & 2:
        size, head, kinds = u32(b, at), u32(b, at + 4), u32(b, at + 8)
        if kinds & 1:
            row["base_path"] = wide(b[at + u32(b, at + 28) : at + size]) if head >= 0x24 and u32(b, at + 28) else ansi(at + u32(b, at + 16))
        row["suffix"] = wide(b[at + u32(b, at + 32) : at + size]) if head >= 0x24 and u32(b, at + 32) else ansi(at + u32(b, at + 24))
        row["target"] = (row["base_path"] or "") + (row["suffix"] or "") or None
        at += size
    for bit, name in ((4, "name"), (8, "relative_path"), (16, "working_dir"), (32, "arguments")):
        if flags & bit:
            n = u16(b, at)
            step = 2 * n if flags & 0x80 else n
            row[name] = b[at + 2 : at + 2 + step].decode("utf-16-le" if flags & 0x80 else "cp949", "replace")
            at += 2 + step
    return row


PREFETCH = "status string, version long, exe string, run_count long, last_runs array<long>"
#: Version: places of the last run, of its number of slots, and of the run count. Fixed values.
PREFETCH_PLACES = {17: (0x78, 1, 0x90), 23: (0x80, 1, 0x98), 26: (0x80, 8, 0xD0), 30: (0x80, 8, 0xD0)}


@parser(f"struct<{PREFETCH.replace(' ', ':').replace(',:', ',')}>", fields(PREFETCH))
def prefetch(b: bytes) -> dict | None:
    """A prefetch file; a compressed one is only marked as such."""
    empty = {"status": None, "version": None, "exe": None, "run_count": None, "last_runs": None}
    if b[:3] == b"MAM":
        return empty | {"status": "compressed_unparsed"}
    version = u32(b, 0)
    if b[4:8] != b"SCCA" or version not in PREFETCH_PLACES:
        return None
    at, slots, count = PREFETCH_PLACES[version]
    times = [u64(b, at + 8 * k) for k in range(slots)]
    return empty | {"status": "ok", "version": version, "exe": wide(b[0x10 : 0x10 + 60]), "run_count": u32(b, count), "last_runs": [t for t in times if 0 < t < 2**63]}


RECYCLED = "version long, size long, deleted long, original_path string"


@parser(f"struct<{RECYCLED.replace(' ', ':').replace(',:', ',')}>", fields(RECYCLED))
def recycled(b: bytes) -> dict | None:
    """An $I file of the recycle bin, either version; times as FILETIME."""
    version = u64(b, 0)
    if version not in (1, 2):
        return None
    path = wide(b[24 : 24 + 520]) if version == 1 else wide(b[28 : 28 + 2 * u32(b, 24)])
    return {"version": version, "size": u64(b, 8), "deleted": u64(b, 16), "original_path": path}


@parser("array<struct<record:long,drive:string,deleted:long,size:long,original_path:string>>", pa.list_(fields("record long, drive string, deleted long, size long, original_path string")))
def recycled_list(b: bytes) -> list[dict]:
    """Records of an INFO2 list: 20 bytes of header, then records of 800."""
    out = []
    for at in range(20, len(b) - 799, 800):
        r = b[at : at + 800]
        name = wide(r[280:800]) or r[20:280].split(b"\0")[0].decode("cp949", "replace")
        out.append({"record": u32(r, 0), "drive": r[4:8].rstrip(b"\0").decode("ascii", "replace"), "deleted": u64(r, 8), "size": u32(r, 16), "original_path": name})
    return out


# --- registry hives


class Hive:
    """Cells of a hive file; offsets are relative to the first bin."""

    def __init__(self, data: bytes):
        if data[:4] != b"regf":
            raise ValueError("not a hive")
        self.data = data

    def cell(self, at: int) -> bytes:
        place = 0x1000 + at
        size = abs(struct.unpack_from("<i", self.data, place)[0])
        if size < 8 or place + size > len(self.data):
            raise ValueError("cell out of bounds")
        return self.data[place + 4 : place + size]

    def children(self, at: int, depth: int = 0) -> Iterator[int]:
        c = self.cell(at)
        kind, n = c[:2], u16(c, 2)
        step = 8 if kind in (b"lf", b"lh") else 4
        for k in range(n):
            child = u32(c, 4 + step * k)
            if kind == b"ri" and depth < 4:
                yield from self.children(child, depth + 1)
            elif kind != b"ri":
                yield child

    def values(self, nk: bytes) -> Iterator[tuple[str, int, bytes]]:
        n, at = u32(nk, 0x24), u32(nk, 0x28)
        for k in range(n if at != 0xFFFFFFFF else 0):
            v = self.cell(u32(self.cell(at), 4 * k))
            size, name = u32(v, 4), v[0x14 : 0x14 + u16(v, 2)].decode("latin-1" if u16(v, 0x10) & 1 else "utf-16-le", "replace")
            yield name, u32(v, 12), v[8 : 8 + (size & 0x7FFFFFFF)] if size & 0x80000000 else self.cell(u32(v, 8))[:size]

    def walk(self) -> Iterator[dict]:
        todo, seen = [(u32(self.data, 0x24), "")], set()
        while todo:
            at, path = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            try:
                nk = self.cell(at)
                if nk[:2] != b"nk":
                    continue
                name = nk[0x4C : 0x4C + u16(nk, 0x48)].decode("latin-1" if u16(nk, 2) & 0x20 else "utf-16-le", "replace")
                key = f"{path}/{name}" if path else name
                written = u64(nk, 4)
                yield {"key_path": key, "value_name": None, "type_id": None, "data": None, "last_write": written}
                for value, kind, data in self.values(nk):
                    yield {"key_path": key, "value_name": value, "type_id": kind, "data": data, "last_write": written}
                if u32(nk, 0x14) and u32(nk, 0x1C) != 0xFFFFFFFF:
                    todo += [(c, key) for c in self.children(u32(nk, 0x1C))]
            except (ValueError, struct.error, IndexError):
                continue


HIVE = "key_path string, value_name string, type_id long, data binary, last_write long"


@parser(f"array<struct<{HIVE.replace(' ', ':').replace(',:', ',')}>>", pa.list_(fields(HIVE)))
def hive_values(b: bytes) -> list[dict]:
    """All keys and values of a hive, flat. Artifacts are filters on key_path (see hive_artifact)."""
    return list(Hive(b).walk())


def rot13(text: Column) -> Column:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    turn = lambda s: s[13:] + s[:13]
    return F.translate(text, up + low, turn(up) + turn(low))


def hive_artifact(key_path: Column) -> Column:
    """Which artifact a key belongs to; NULL for others."""
    low = F.lower(key_path)
    out = None
    for mark, name in (("appcompatcache", "shimcache"), ("/enum/usbstor", "usbstor"), ("/userassist/", "userassist"), ("/currentversion/run", "run_keys"), ("/explorer/recentdocs", "recentdocs"), ("inventoryapplicationfile", "amcache")):
        out = F.when(low.contains(mark), F.lit(name)) if out is None else out.when(low.contains(mark), F.lit(name))
    return out


# --- workbooks and text

_ALIASES = {
    "seq": ("연번", "순번", "번호", "no", "no.", "seq"), "name": ("파일명", "파일이름", "filename", "name"), "ext": ("확장자", "확장자명", "ext", "extension"), "size": ("파일크기", "크기", "size"),
    "path": ("경로", "파일경로", "path", "fullpath"), "created": ("생성일시", "생성일", "created"), "modified": ("수정일시", "수정일", "modified"), "accessed": ("접근일시", "접근일", "accessed"), "note": ("비고", "note", "remarks"),
}
SHEET_COLUMNS = [x.strip().split(" ")[0] for x in CERTIFICATE.split(",")]


def header_field(text: str) -> str | None:
    t = re.sub(r"\s", "", text or "").lower()
    for h in ("sha256", "sha1", "md5"):
        if h in t.replace("-", ""):
            return h
    return next((f for f, names in _ALIASES.items() if any(t == n or (len(n) > 2 and t.startswith(n)) for n in names)), None)


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """sheet name, row number and cell texts of a workbook, sheets in order; needs nothing but the XML."""
    import xml.etree.ElementTree as ET

    z = zipfile.ZipFile(io.BytesIO(content))
    tail = lambda e: e.tag.rsplit("}", 1)[-1]
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if tail(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if tail(si) == "si"]
    targets = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        targets = {r.get("Id"): r.get("Target", "").lstrip("/").removeprefix("xl/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = []
    if "xl/workbook.xml" in z.namelist():
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter():
            if tail(s) == "sheet":
                rid = next((v for k, v in s.attrib.items() if k.endswith("}id")), None)
                sheets.append((s.get("name"), f"xl/{targets.get(rid, '')}"))
    sheets = [(n, f) for n, f in sheets if f in z.namelist()] or [(f, f) for f in sorted(z.namelist()) if f.startswith("xl/worksheets/") and f.endswith(".xml")]
    for name, file in sheets:
        for number, row in enumerate((r for r in ET.fromstring(z.read(file)).iter() if tail(r) == "row"), 1):
            cells: list[str] = []
            for c in (c for c in row if tail(c) == "c"):
                letters = re.match("[A-Z]+", c.get("r", ""))
                at = len(cells)
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                cells += [""] * (at + 1 - len(cells))
                text = "".join(t.text or "" for t in c.iter() if tail(t) in ("v", "t"))
                if c.get("t") == "s" and text.isdigit() and int(text) < len(shared):
                    text = shared[int(text)]
                elif re.fullmatch(r"-?\d+\.0", text):
                    text = text[:-2]
                cells[at] = text
            yield name, int(row.get("r", number)), cells


@parser(f"array<struct<{CERTIFICATE.replace(' ', ':').replace(',:', ',')}>>", pa.list_(fields(CERTIFICATE)))
def read_xlsx(content: bytes) -> list[dict]:
    """Rows of every sheet under the nearest header row above; a sheet without one gives rows whose path is the first cell that looks like one."""
    out, header, sheet = [], None, None
    for name, number, cells in sheet_rows(content):
        if name != sheet:
            sheet, header = name, None
        found = [header_field(c) for c in cells]
        if sum(f is not None for f in found) >= 2:
            header = found
            continue
        if not any(c.strip() for c in cells):
            continue
        row = dict.fromkeys(SHEET_COLUMNS, "") | {"sheet": name, "row": number}
        if header:
            row |= {f: c for f, c in zip(header, cells, strict=False) if f}
        else:
            row["path"] = next((c for c in cells if re.search(r"[\\/]|\.[A-Za-z0-9]{1,5}$", c)), "")
        out.append(row)
    return out


def decode(b: bytes) -> str | None:
    """utf-8, then cp949, then utf-16."""
    if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return b.decode("utf-16", "replace")
    for name in ("utf-8-sig", "cp949", "utf-16-le"):
        try:
            return b.decode(name)
        except UnicodeDecodeError:
            continue
    return None


_PDF_TEXT = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|')|\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ", re.S)
_PDF_PART = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)


def pdf_text(b: bytes) -> str | None:
    """Literal strings shown by the page streams, one line each."""
    plain = lambda s: re.sub(rb"\\([nrtbf()\\])", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(m[1], m[1] if m[1] in b"()\\" else b""), s)
    lines = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\n?endstream", b, re.S):
        try:
            s = zlib.decompress(m[1])
        except zlib.error:
            s = m[1]
        for t in _PDF_TEXT.finditer(s):
            raw = plain(t[1]) if t[1] is not None else b"".join(plain(p) for p in _PDF_PART.findall(t[2]))
            lines.append(decode(raw) or "")
    return "\n".join(lines) or None


def zip_text(b: bytes, depth: int) -> str | None:
    z = zipfile.ZipFile(io.BytesIO(b))
    names = z.namelist()
    if any(n.startswith(("word/", "xl/", "ppt/", "Contents/")) for n in names):
        parts = [re.sub(r"<[^>]+>", " ", z.read(n).decode("utf-8", "replace")) for n in names if n.endswith((".xml", ".txt"))]
    else:
        parts = [t for n in names if depth < 2 and z.getinfo(n).file_size <= 1 << 24 and (t := text_of(z.read(n), "." + n.rsplit(".", 1)[-1].lower(), depth + 1))]
    return "\n".join(parts) or None


COMPOUND = bytes.fromhex("d0cf11e0a1b11ae1")


def compound_streams(b: bytes) -> Iterator[tuple[str, bytes]]:
    """Name and bytes of each stream of a compound file, by its allocation tables; damaged chains end where they break."""
    size, mini = 1 << u16(b, 30), 1 << u16(b, 32)
    sector = lambda k: b[(k + 1) * size : (k + 2) * size]
    numbers = lambda raw: struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
    lists, more = [k for k in numbers(b[76:512]) if k < 0xFFFFFFFA], u32(b, 68)
    while more < 0xFFFFFFFA and len(lists) < len(b) // size + 1:
        held = numbers(sector(more))
        lists += [k for k in held[:-1] if k < 0xFFFFFFFA]
        more = held[-1]
    table = [n for k in lists for n in numbers(sector(k))]

    def chain(at: int, links: list[int]) -> list[int]:
        out, seen = [], set()
        while at < len(links) and at not in seen:
            seen.add(at)
            out.append(at)
            at = links[at]
        return out

    whole = lambda at: b"".join(sector(k) for k in chain(at, table))
    directory = whole(u32(b, 48))
    small = [n for k in chain(u32(b, 60), table) for n in numbers(sector(k))]
    limit, root = u32(b, 56), b""
    for at in range(0, len(directory) - 127, 128):
        entry = directory[at : at + 128]
        kind, first, length = entry[66], u32(entry, 116), u32(entry, 120)
        name = entry[: max(u16(entry, 64) - 2, 0)].decode("utf-16-le", "replace")
        if kind == 5:
            root = whole(first)
        elif kind == 2:
            data = whole(first) if length >= limit else b"".join(root[k * mini : (k + 1) * mini] for k in chain(first, small))
            yield name, data[:length]


def compound_text(b: bytes) -> str | None:
    """Text of a compound file: readable two-byte runs of each stream, deflated ones inflated first; of the whole file if its tables are broken."""
    try:
        streams = [data for _, data in compound_streams(b)]
    except (struct.error, IndexError, ValueError):
        streams = [b]
    out: list[str] = []
    for data in streams:
        try:
            data = zlib.decompressobj(-15).decompress(data)
        except zlib.error:
            pass
        out += _RUN16.findall(data[: len(data) // 2 * 2].decode("utf-16-le", "replace"))
    return "\n".join(dict.fromkeys(out)) or None


PLAIN_TYPES = (".txt", ".csv", ".tsv", ".json", ".xml", ".htm", ".html", ".log", ".ini", ".eml", ".rtf", ".md")
ZIP_TYPES = (".docx", ".xlsx", ".pptx", ".hwpx", ".zip")
#: Suffixes that text can be extracted from.
TEXT_TYPES = (*PLAIN_TYPES, *ZIP_TYPES, ".pdf", ".hwp", ".doc", ".xls", ".ppt")


def text_of(b: bytes, ext: str, depth: int = 0) -> str | None:
    if ext in ZIP_TYPES or b[:4] == b"PK\3\4":
        return zip_text(b, depth)
    if ext == ".pdf" or b[:5] == b"%PDF-":
        return pdf_text(b)
    if ext in PLAIN_TYPES:
        return decode(b)
    if b[:8] == COMPOUND:
        return compound_text(b)
    return None


@parser("string", pa.string())
def extract_text(content: bytes, ext: str) -> str | None:
    """Text of a file by suffix and signature; NULL if it has none or isn't known."""
    return text_of(content, ext)


# --- what a hive's values hold, members of a package


@parser("string", pa.string())
def hive_text(data: bytes, kind: int) -> str | None:
    """A value's text by its type: strings without their final NULs, numbers as digits; NULL for other types."""
    if kind in (1, 2, 7):
        return data.decode("utf-16-le", "replace").rstrip("\0")
    number = {4: u32, 11: u64}.get(kind)
    return str(number(data, 0)) if number else None


SHIM = "path string, filetime long, how string"
#: Mark, reserved, size of the entry, bytes of its path, FILETIME, reserved; the path follows.
_SHIM_HEAD, _SHIM_SIZE = "<4s4xIIQ8x", 32
#: A path with a drive, a share or a device before it, or one of a program.
_PATH = re.compile(r'''(?:[A-Za-z]:|\\\\[^\\/:*?"<>|\x00-\x1f]+|\\\?\?\\[A-Za-z]:)(?:\\[^\\/:*?"<>|\x00-\x1f]+)+|(?:[^\\/:*?"<>|\x00-\x1f]+\\)+[^\\/:*?"<>|\x00-\x1f]+\.exe\b''', re.I)


@parser(f"array<struct<{SHIM.replace(' ', ':').replace(',:', ',')}>>", pa.list_(fields(SHIM)))
def shimcache_entries(blob: bytes) -> list[dict]:
    """Programs in an application compatibility cache: its entries, as far as their heads make sense; where there are none, texts of two-byte characters
    that read as paths. An entry's path is whole two-byte text without control characters, inside the value and inside the entry."""
    entries, past = [], 0
    for mark in re.finditer(b"00ts", blob):
        if mark.start() < past or len(blob) - mark.start() < _SHIM_SIZE:
            continue  # bytes of an entry that has been read, or a torn head
        _, size, length, filetime = struct.unpack_from(_SHIM_HEAD, blob, mark.start())
        raw = blob[mark.start() + _SHIM_SIZE :][:length]
        path = raw.decode("utf-16-le", "replace").rstrip("\0")
        if length % 2 or len(raw) < length or not path or not path.isprintable():
            continue
        entries.append({"path": path, "filetime": min(filetime, 2**63 - 1), "how": "entry"})
        past = mark.start() + _SHIM_SIZE + length
    if entries:
        return entries
    texts = [m[0] for shift in (0, 1) for m in _PATH.finditer(blob[shift:].decode("utf-16-le", "replace"))]
    return [{"path": t, "filetime": None, "how": "text"} for t in dict.fromkeys(texts) if t.isascii()]


@parser("array<string>", pa.list_(pa.string()))
def evtx_strings(content: bytes, limit: int) -> list[str]:
    """Readable runs of an event log, its deflated chunks put back first."""
    return runs(inflate_chunks(content), limit)


MEMBERS = "name string, content binary"


@parser(f"array<struct<{MEMBERS.replace(' ', ':').replace(',:', ',')}>>", pa.list_(fields(MEMBERS)))
def zip_members(content: bytes, name: str) -> list[dict]:
    """Files in an archive, and the workbooks and PDFs in archives directly inside it, as outer!inner. A workbook, PDF, CSV or text is its own
    only member, and so is what isn't an archive."""
    if name.lower().endswith((".xlsx", ".pdf", ".csv", ".txt")) or not zipfile.is_zipfile(io.BytesIO(content)):
        return [{"name": name, "content": content}]
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            data = z.read(info)
            out.append({"name": info.filename, "content": data})
            if info.filename.lower().endswith(".zip") and zipfile.is_zipfile(io.BytesIO(data)):
                with zipfile.ZipFile(io.BytesIO(data)) as inner:
                    out += [{"name": f"{info.filename}!{i.filename}", "content": inner.read(i)} for i in inner.infolist() if not i.is_dir() and i.filename.lower().endswith((".xlsx", ".pdf"))]
    return sorted(out, key=lambda m: m["name"])
