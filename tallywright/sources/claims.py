"""Readers of claimed-item lists. Each gives schema.ITEMS; a row that can't be read stays, marked unparsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import digests, paths
from .parsers import extract_text, read_xlsx

#: Names of columns and keys in lists, after lower() and without spaces. Fixed values.
PATH_NAMES = ("path", "filepath", "file_path", "fullpath", "full_path", "경로", "파일경로", "name", "filename", "파일명")
HASH_NAMES = ("sha256", "sha-256", "sha1", "sha-1", "md5", "hash", "해시", "해시값")
LIST_NAMES = ("items", "files", "seized", "seized_files", "likely_seized_files", "list", "entries", "results")


def item(ord_: Column, claimed: Column, digest: Column, raw: Column, meta: Column | None = None) -> list[Column]:
    path = F.nullif(F.trim(claimed), F.lit(""))
    held = F.nullif(F.lower(F.trim(digest)), F.lit(""))
    return [
        ord_.cast("long").alias("ord"), path.alias("claimed_path"), paths.normalise(path).alias("rel"), held.alias("digest"), digests.algorithm(held).alias("hash_algo"),
        path.isNull().alias("unparsed"), raw.alias("raw"), (meta if meta is not None else F.lit(None)).cast("map<string,string>").alias("claimed_meta"),
    ]


def text_items(lines: DataFrame) -> DataFrame:
    """lines (ord, value): blank and # lines aside, a leading digest and spaces, or '|' columns whose last is the path."""
    text = F.trim("value")
    kept = lines.where((text != "") & ~text.startswith("#")).withColumn("t", text)
    last = F.trim(F.element_at(F.split("t", "\\|"), -1))
    piped = F.col("t").contains("|") & last.rlike(r"^([A-Za-z]:)?[\\/]|[\\/]|\.[A-Za-z0-9]{1,5}$")
    lead = r"^([0-9a-fA-F]{32,128})\s+(.+)$"
    hashed = F.col("t").rlike(lead)
    path = F.when(piped, last).when(hashed, F.regexp_extract("t", lead, 2)).otherwise(F.col("t"))
    return kept.select(*item(F.col("ord"), path, F.when(~piped & hashed, F.regexp_extract("t", lead, 1)), F.col("t")))


def _pick(columns: list[str], names: tuple[str, ...]) -> str | None:
    by = {c.strip().lower().replace(" ", ""): c for c in columns}
    return next((by[n] for n in names if n in by), None)


def csv_items(rows: DataFrame) -> DataFrame:
    """rows with a header and ord; one digest column serves the whole file."""
    columns = [c for c in rows.columns if c != "ord"]
    path, digest = _pick(columns, PATH_NAMES), _pick(columns, HASH_NAMES)
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    meta = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    return rows.select(*item(F.col("ord"), F.col(f"`{path}`") if path else F.lit(None).cast("string"), F.col(f"`{digest}`") if digest else F.lit(None).cast("string"), raw, meta))


def json_items(texts: DataFrame) -> DataFrame:
    """texts (value): whole JSON texts; an array, or an object with an array under a known key. Entries are paths or objects."""
    parsed = texts.select(F.try_parse_json("value").alias("v"), "value")
    lists = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in LIST_NAMES], F.try_variant_get("v", "$", "array<variant>"))
    entries = parsed.select("value", F.posexplode_outer(lists).alias("ord", "e"))
    get = lambda names: F.coalesce(*[F.nullif(F.try_variant_get("e", f'$["{n}"]', "string"), F.lit("")) for n in names])
    plain = F.when(F.schema_of_variant("e") == "STRING", F.try_variant_get("e", "$", "string"))
    raw = F.coalesce(F.to_json("e"), F.col("value"))
    return entries.select(*item(F.coalesce("ord", F.lit(0)), F.coalesce(plain, get(PATH_NAMES)), get(HASH_NAMES), raw))


def sheet_items(files: DataFrame) -> DataFrame:
    """files (content) of workbooks; the strongest digest of each row."""
    read = files.select(read_xlsx("content").alias("rows"))
    rows = read.select(F.explode("rows").alias("r")).select("r.*")
    digest = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("sha256", "sha1", "md5")])
    path = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("path", "name")])
    names = ("seq", "name", "ext", "size", "created", "modified", "accessed", "note", "sheet")
    out = rows.select(*item(F.col("row"), path, digest, F.to_json(F.struct("*")), F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])))
    return out.unionByName(unread(read.where(F.coalesce(F.size("rows"), F.lit(0)) <= 0), "no rows of a list found, or not a workbook"))


def unread(files: DataFrame, why: str) -> DataFrame:
    """One unparsed item for each row of files, so that a list that can't be read is counted."""
    none = F.lit(None).cast("string")
    return files.select(*item(F.lit(0), none, none, F.lit(why)))


def pdf_items(files: DataFrame) -> DataFrame:
    """files (content) of PDFs: their text layer as a text list; without one, a single unparsed row."""
    texts = files.select(extract_text("content", F.lit(".pdf")).alias("t"))
    lines = texts.where(F.trim("t") != "").select(F.posexplode(F.split("t", "\n")).alias("ord", "value"))
    blank = texts.where(F.coalesce(F.trim("t"), F.lit("")) == "").select(*item(F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("no text layer: needs OCR")))
    return text_items(lines).unionByName(blank)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """A list file by suffix, or by its first character where that is [ or {; a text file whose first line has a comma is read as CSV. An
    empty file gives no rows; an old binary workbook gives one unparsed item."""
    low = path.lower()
    if low.endswith(".xls"):
        return unread(spark.read.format("binaryFile").load(path).select("path"), "old binary workbook: save it as .xlsx or CSV")
    if low.endswith((".xlsx", ".xlsm")):
        return sheet_items(spark.read.format("binaryFile").load(path))
    if low.endswith(".pdf"):
        return pdf_items(spark.read.format("binaryFile").load(path))
    if low.endswith(".json"):
        return json_items(spark.read.text(path, wholetext=True))
    head = spark.read.text(path).limit(1).collect()
    if head and head[0][0].lstrip("\ufeff \t")[:1] in ("[", "{"):
        return json_items(spark.read.text(path, wholetext=True))
    if low.endswith(".csv") or (head and "," in head[0][0]):
        return csv_items(spark.read.csv(path, header=True, multiLine=True).withColumn("ord", F.monotonically_increasing_id()))
    return text_items(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()))


#: Columns of the canonical list, in order. Fixed values.
CANONICAL = ("seq", "name", "ext", "size", "path", "md5", "sha1", "sha256", "created", "modified", "accessed", "note", "sheet", "row", "unparsed")


def canonical(items: DataFrame) -> DataFrame:
    """Items as rows of one list format; what couldn't be read keeps up to 400 characters of its source as a note."""
    meta = lambda n: F.element_at("claimed_meta", n)
    own = {
        "name": F.coalesce(meta("name"), paths.basename(F.col("rel"))), "ext": F.coalesce(meta("ext"), paths.extension(F.col("rel"))), "path": F.col("claimed_path"),
        **{n: F.when(F.col("hash_algo") == n, F.col("digest")) for n in ("md5", "sha1", "sha256")},
        "note": F.when(F.col("unparsed"), F.substring("raw", 1, 400)).otherwise(meta("note")), "row": F.col("ord").cast("string"), "unparsed": F.col("unparsed").cast("string"),
    }
    return items.select(*[F.coalesce(own.get(n, meta(n)), F.lit("")).alias(n) for n in CANONICAL])


def read_journal(rows: DataFrame) -> DataFrame:
    """Change-journal exports. rows: ord and cells array<string>, first row possibly a header. Gives file_name, reason_mask, timestamp_utc, usn.

    Without a header, a row's cells are told apart by shape: the name is the first that is neither number nor date, the time
    the first date, the reasons the last that has '|', words of reasons, or a mask, the number before the time is the USN."""
    from ..functions import reasons, timeutil

    names = {"file_name": ("filename", "name", "파일명"), "reason": ("reason", "reasons", "updatereasons"), "time": ("timestamp", "time", "updatetimestamp", "datetime"), "usn": ("usn", "updatesequencenumber")}
    head = rows.orderBy("ord").limit(1).collect()
    plain = ["".join(ch for ch in (c or "").lower() if ch.isalpha()) for c in (head[0]["cells"] if head else [])]
    place = {k: next((i for i, c in enumerate(plain) if c in v), None) for k, v in names.items()}
    get = lambda i: F.get("cells", F.lit(i)) if i is not None else F.lit(None).cast("string")
    if place["file_name"] is not None:
        body = rows.where(F.col("ord") != head[0]["ord"])
        name, reason, time, usn = (get(place[k]) for k in ("file_name", "reason", "time", "usn"))
    else:
        body = rows
        number, date = r"^\s*(0x[0-9a-fA-F]+|-?\d+)\s*$", r"^\s*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}[ T]"
        words = "|".join(n.split("_")[-1] for n in ("file_create", "file_delete", "close", "data_extend", "basic_info_change", "rename_old"))
        is_time = lambda c: c.rlike(date) | (c.rlike(r"^\s*\d+\s*$") & (c.try_cast("long") > 10**15))
        name = F.get(F.filter("cells", lambda c: ~c.rlike(number) & ~c.rlike(date) & (F.trim(c) != "")), F.lit(0))
        time = F.get(F.filter("cells", is_time), F.lit(0))
        body = body.withColumns({"_name": name, "_time": time})  # once a row, not once a cell
        name, time = F.col("_name"), F.col("_time")
        texts = F.filter("cells", lambda c: (c.contains("|") | F.lower(c).rlike(words)) & ~c.rlike(date) & (c != F.col("_name")))
        masks = F.filter("cells", lambda c: c.rlike(r"^\s*0x[0-9a-fA-F]+\s*$"))
        reason = F.coalesce(F.element_at(F.when(F.size(texts) > 0, texts), -1), F.element_at(F.when(F.size(masks) > 0, masks), -1))
        before = F.slice("cells", F.lit(1), F.greatest(F.array_position("cells", time).cast("int") - 1, F.lit(0)))
        numbers = F.filter(before, lambda c: c.rlike(r"^\s*\d+\s*$"))
        usn = F.element_at(F.when(F.size(numbers) > 0, numbers), -1)
    mask = F.coalesce(digests.number(reason), reasons.mask(reason))
    out = body.select(F.trim(name).alias("file_name"), mask.alias("reason_mask"), timeutil.usn_time(time).alias("timestamp_utc"), digests.number(usn).alias("usn"))
    return out.where("file_name <> ''")


#: Lists that a collector's output may hold, the most telling first. Fixed values.
SOURCE_PRIORITY = ("report.json", "selected_files_ranked.txt", "likely_seized_files.txt", "selected_files.txt", "file_paths.txt", "copy_candidates.txt", "user_files.txt")
#: What is tried, in path order, where none of those is there. Fixed values.
OTHER_SOURCES = (".xlsx", ".csv", ".json", ".txt")


def source_candidates(files: DataFrame) -> DataFrame:
    """path, rank of the files (path) that may hold a collector's list, rank 1 to be tried first: by name, of equal names the last in path
    order, which is the newest scan; lists of other names only where there is none of a known one."""
    name = paths.basename(F.col("path"))
    known = F.array_position(F.array(*map(F.lit, SOURCE_PRIORITY)), name)
    rows = files.select("path", F.when(known > 0, known).alias("place"), paths.extension(F.col("path")).isin(*OTHER_SOURCES).alias("other"))
    named = rows.where("place IS NOT NULL")
    none = named.limit(1).groupBy().count().where("count = 0").select(F.lit(True).alias("_none"))  # one row, if there is none
    rest = rows.where("place IS NULL AND other").join(none)
    best = Window.orderBy("place", F.desc("path"))
    return named.select("path", F.row_number().over(best).alias("rank")).unionByName(rest.select("path", F.row_number().over(Window.orderBy("path")).alias("rank")))


def read_best(spark: SparkSession, files: DataFrame, folder: str = "") -> tuple[DataFrame | None, str | None]:
    """Items of the first candidate, in rank order, with a row that can be read, or else of the first at all; and its path. Lists of several scans
    are never mixed. files (path) below folder."""
    first: tuple[DataFrame | None, str | None] = None, None
    for (path,) in source_candidates(files).orderBy("rank").select("path").collect():  # names only
        items = read_claims(spark, f"{folder.rstrip('/')}/{path}" if folder else path)
        if items.where("NOT unparsed").limit(1).count():
            return items, path
        first = first if first[1] else (items, path)
    return first
