"""Classification of paths as possible evidence, by first matching rule; and items left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

# Names and suffixes as the formats and tools have them.
REPORT_EXTENSIONS = (".txt", ".csv", ".tsv", ".json", ".xml", ".htm", ".html", ".log", ".ini", ".eml", ".rtf", ".xlsx", ".xls", ".pdf", ".spl", ".shd", ".emf")
SOURCE_HINTS = ("evidence", "manifest", "list", "report", "seiz", "export", "print", "scan", "목록", "압수", "조서", "증거")
LIST_EXTENSIONS = (".pdf", ".hwp", ".xlsx", ".xls", ".csv", ".docx", ".txt")
LEFTOVER_CONTAINERS = (".zip", ".7z", ".rar", ".ad1", ".e01", ".ex01", ".l01", ".lxf", ".tar", ".gz", ".001", ".dd", ".img")
IMAGE_CONTAINERS = (".ad1", ".e01", ".ex01", ".l01", ".lx01", ".s01", ".aff", ".afd", ".afm", ".m01", ".zip", ".7z", ".rar", ".tar", ".gz", ".dd", ".img", ".raw", ".001", ".vhd", ".vhdx", ".ufd")
NAME_HINTS = ("목록", "리스트", "압수", "전자정보", "압수물", "선별", "영장", "조서", "수사", "증거", "list", "seiz", "evid", "forens", "output", "report", "result", "export", "extract", "select", "item")
TOOL_MARKERS = {
    "ftkimager": "FTK Imager",
    "imager_lite": "FTK Imager Lite",
    "encase": "EnCase",
    "enstart": "EnCase Portable",
    "axiom": "Magnet AXIOM",
    "outrider": "Magnet OUTRIDER",
    "kape": "KAPE",
    "mdlive": "MD-LIVE",
    "md-live": "MD-LIVE",
    "mdnext": "MD-NEXT",
    "md-next": "MD-NEXT",
    "dfas": "DFAS Pro",
    "crane": "Forensic Crane (포크레인)",
    "xways": "X-Ways",
    "xwforens": "X-Ways Forensics",
    "dumpit": "DumpIt",
    "winpmem": "WinPmem",
    "ramcapt": "Belkasoft RAM Capturer",
    "cellebrite": "Cellebrite",
    "ufed": "Cellebrite UFED",
    "graykey": "GrayKey",
    "tableau": "Tableau",
    "guymager": "Guymager",
    "dc3dd": "dc3dd",
    "dcfldd": "dcfldd",
    "osforensics": "OSForensics",
    "belkasoft": "Belkasoft",
    "passware": "Passware",
    "nuix": "Nuix",
}
EVENT_LOG_HINTS = ("system.evtx", "security.evtx", "printservice", "operational.evtx", "kernel-pnp", "partition")
HIVES = ("system", "software", "sam", "security", "ntuser.dat", "usrclass.dat", "amcache.hve")
MOBILE_TARGETS = {
    "kakaotalk_pc": ("Users/*/AppData/Local/Kakao/KakaoTalk/*",),
    "itunes_backup": ("Users/*/AppData/Roaming/Apple Computer/MobileSync/Backup/*", "Users/*/Apple/MobileSync/Backup/*"),
    "smartswitch": ("Users/*/Documents/*[Ss]mart[ _-][Ss]witch*/*",),
    "whatsapp_desktop": ("Users/*/AppData/Local/Packages/*WhatsApp*/LocalState/*/*",),
    "telegram_desktop": ("Users/*/AppData/Roaming/Telegram Desktop/tdata/*/*",),
}


def first(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds; NULL if none does."""
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), F.lit(rules[0][1]))
    for test, name in rules[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), F.lit(name))
    return out


def tool_label(stem: Column) -> Column:
    """The first marker, in the order of the table, that the text contains in any case."""
    low = F.lower(stem)
    return first(*[(low.contains(m), label) for m, label in TOOL_MARKERS.items()])


def name_hinted(name: Column) -> Column:
    """Latin hints only at the start of a word, Korean ones anywhere."""
    low = F.lower(name)
    latin = "|".join(h for h in NAME_HINTS if h.isascii())
    korean = "|".join(h for h in NAME_HINTS if not h.isascii())
    return low.rlike(f"(?<![a-z0-9])(?:{latin})") | low.rlike(korean)


def leftover_category(path: Column, bounded: bool = True) -> Column:
    """bounded: a time window limits the search, so that a bare list suffix means something."""
    name, ext = paths.basename(path), paths.extension(path)
    hinted, container, listed = name_hinted(name), ext.isin(*LEFTOVER_CONTAINERS), ext.isin(*LIST_EXTENSIONS)
    rules = [(container & hinted, "container_named"), (container, "container_in_window"), (listed & hinted, "list_named"), (hinted, "name_match")]
    return first(*rules, *([(listed, "possible_list")] if bounded else []))


def source_reason(path: Column, mtime_ns: Column, since_ns: int | None = None) -> Column:
    """spool, recycle_bin or temp; temp only for reports and hinted names, not before since_ns."""
    parts, name = F.split(F.lower(path), "/"), F.lower(paths.basename(path))
    hinted = paths.extension(path).isin(*REPORT_EXTENSIONS) | F.exists(F.array(*map(F.lit, SOURCE_HINTS)), lambda h: name.contains(h))
    recent = F.lit(True) if since_ns is None else mtime_ns >= since_ns
    return first(
        (F.array_contains(parts, "spool") & F.array_contains(parts, "printers"), "spool"),
        (F.exists(parts, lambda p: p.startswith("$recycle.bin") | (p == "recycler")), "recycle_bin"),
        (F.array_contains(parts, "temp") & recent & hinted, "temp"),
    )


def artifact_category(path: Column) -> Column:
    low, parts = F.lower(path), F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    logs = F.array_contains(parts, "winevt")
    return first(
        (F.array_contains(parts, "prefetch"), "prefetch"),
        (logs & F.exists(F.array(*map(F.lit, EVENT_LOG_HINTS)), lambda h: name.contains(h)), "evtx"),
        (low.contains("microsoft/windows/recent") | F.array_contains(parts, "automaticdestinations") | F.array_contains(parts, "customdestinations"), "recent_items"),
        (name.isin(*HIVES, "setupapi.dev.log"), "registry_or_device_log"),
        (low.startswith("windows/system32/drivers/"), "drivers"),
    )


def mobile_target(path: Column) -> Column:
    """Phone backups and messengers kept on a computer, by case-sensitive patterns."""
    return first(*[(path.rlike(paths.glob_to_regex(p)), name) for name, ps in MOBILE_TARGETS.items() for p in ps])


def is_sqlite(content: Column) -> Column:
    return F.substring(content, 1, 16) == F.lit(b"SQLite format 3\0")


def containers(files: DataFrame, since_ns: int | None = None) -> DataFrame:
    """Evidence images and archives by suffix."""
    out = files.where((F.col("kind") == "file") & paths.extension(F.col("path")).isin(*IMAGE_CONTAINERS))
    return out if since_ns is None else out.where(F.col("mtime_ns") >= since_ns)


def observed_tools(evidence: DataFrame) -> DataFrame:
    """label, items, first_path: tools that paths (path) name."""
    return evidence.withColumn("label", tool_label(paths.stem(F.col("path")))).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("items"), F.min("path").alias("first_path"))


def recycle_pairs(info: DataFrame, files: DataFrame) -> DataFrame:
    """info (path of an $I file, ...) with the $R file of the same folder and suffix, NULL if it is gone."""
    name = paths.basename(F.col("path"))
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    wanted = info.withColumn("_content", F.concat(folder, F.lit("$R"), F.substring(name, 3, 1000)))
    held = files.select(F.col("path").alias("content_path"), F.col("size").alias("content_size"))
    return wanted.join(held, F.col("_content") == F.col("content_path"), "left").drop("_content")


def recycled_list_pairs(info: DataFrame, files: DataFrame, since_filetime: int, until_filetime: int) -> DataFrame:
    """category, original_path, deleted, size, content_path, content_size of the records of old recycle-bin lists in a window.

    info: path of the list, and r, one of its records (as from parsers.recycled_list). What was deleted stands beside the list as
    D, the drive's letter, the record's number and the suffix; content_path is NULL if it's gone."""
    r = lambda c: F.col(f"r.{c}")
    original = F.when(r("drive").contains(":"), F.concat(r("drive"), r("original_path"))).otherwise(r("original_path"))
    held = info.where((r("original_path") != "") & (r("drive") != "") & r("deleted").between(since_filetime, until_filetime)).select("path", r("record").alias("record"), r("drive").alias("drive"), original.alias("original_path"), r("deleted").alias("deleted"), r("size").alias("size"))
    ext = F.coalesce(paths.extension(F.translate("original_path", "\\", "/")), F.lit(""))
    folder = F.substring("path", F.lit(1), F.length("path") - F.length(paths.basename(F.col("path"))))
    wanted = held.withColumn("_content", F.concat(folder, F.lit("D"), F.lower(F.substring("drive", 1, 1)), "record", ext))
    there = files.select(F.col("path").alias("content_path"), F.col("size").alias("content_size"))
    telling = deleted_leftover(F.translate("original_path", "\\", "/"))
    joined = wanted.join(there, F.col("_content") == F.col("content_path"), "left")
    return joined.select(F.when(telling, F.lit("bin_list_or_container")).otherwise(F.lit("bin_deleted")).alias("category"), "original_path", "deleted", "size", "content_path", "content_size")


def recycle_bin(info: DataFrame, files: DataFrame, since_filetime: int, until_filetime: int) -> DataFrame:
    """category, original_path, deleted, size, content_path, content_size of the $I files of recycle bins whose files were deleted in a window.

    info: path of the $I file, and r, its record (as from parsers.recycled). content_path is NULL if the $R file is gone."""
    r = lambda c: F.col(f"r.{c}").alias(c)
    held = info.where(F.col("r.deleted").between(since_filetime, until_filetime)).select("path", r("original_path"), r("deleted"), r("size"))
    telling = deleted_leftover(F.translate("original_path", "\\", "/"))
    return recycle_pairs(held, files).select(F.when(telling, F.lit("bin_list_or_container")).otherwise(F.lit("bin_deleted")).alias("category"), "original_path", "deleted", "size", "content_path", "content_size")


def leftover_summary(rows: DataFrame, most: int | None = None) -> DataFrame:
    """channel, category, items of leftovers, and truncated: more than most items in it, where a report is to list so many only; none is dropped."""
    counted = rows.groupBy("channel", "category").agg(F.count("*").alias("items"))
    return counted.withColumn("truncated", F.lit(False) if most is None else F.col("items") > most)


def deleted_leftover(name: Column) -> Column:
    """Whether a deleted name looks like a list or container, or hints at one, with or without a time window."""
    return paths.extension(name).isin(*LIST_EXTENSIONS, *LEFTOVER_CONTAINERS) | F.coalesce(name_hinted(name), F.lit(False))


def leftovers(files: DataFrame, since_ns: int | None, until_ns: int | None, deleted: DataFrame | None = None, binned: DataFrame | None = None) -> DataFrame:
    """channel, name, category of files in the window, of deletions (file_name, as from journal.deletions) that look like lists or
    containers, which are all deleted_in_window, and of what lies in recycle bins (as from recycle_bin and recycled_list_pairs)."""
    bounded = since_ns is not None
    inside = files.where("kind = 'file'")
    if bounded:
        inside = inside.where(F.col("mtime_ns") >= since_ns)
    if until_ns is not None:
        inside = inside.where(F.col("mtime_ns") <= until_ns)
    out = inside.select(F.lit("file").alias("channel"), F.col("path").alias("name"), leftover_category(F.col("path"), bounded).alias("category"))
    if deleted is not None:
        out = out.unionByName(deleted.where(deleted_leftover(F.col("file_name"))).select(F.lit("journal").alias("channel"), F.col("file_name").alias("name"), F.lit("deleted_in_window").alias("category")))
    if binned is not None:
        out = out.unionByName(binned.select(F.lit("recycle_bin").alias("channel"), F.col("original_path").alias("name"), "category"))
    return out.where("category IS NOT NULL")


def pick_source(candidates: DataFrame, partition: list[str], priority: str, newest: str) -> DataFrame:
    """The best candidate of each group: first one with a parsed row (parsed > 0), by priority, then newest; else the best one readable."""
    order = Window.partitionBy(*partition).orderBy((F.col("parsed") > 0).desc(), F.col(priority), F.col(newest).desc())
    return candidates.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
