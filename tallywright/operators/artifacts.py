"""Artifacts of program use among files with content: prefetch, event logs, links, registry hives, and the tools that they name.

Each kind is a filter on the path, a parser on the bytes and built-in functions on what it gives. Inputs are files (path, size, mtime_ns,
content); a file that a parser can't read gives a row without details or none, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, timeutil
from ..sources import parsers
from . import evidence

#: Kinds that a time limit applies to; logs and hives are kept whatever their time.
TIMED = ("prefetch", "recent_items", "drivers")
#: What device logs and hives say of storage devices and tools. Fixed value.
DEVICE_PATTERN = r"USBSTOR|VID_[0-9A-Fa-f]{4}|Disk&Ven_|serial|FTK|EnCase|AXIOM|OUTRIDER|KAPE|MD-LIVE"
#: Texts in a link that read as a target. Fixed value.
TARGET_PATTERN = r"(?i)[A-Za-z]:[\\/]|^/|\.(lnk|exe|txt|pdf|docx?|hwp)\b"
USB_LABEL = "USB device (collection media?)"


def exe_guess(name: Column) -> Column:
    """The program that a prefetch file is named after; the name's stem if it has no hash."""
    exe = F.regexp_extract(name, r"(?i)^(.+)-[0-9a-f]{8,16}\.pf$", 1)
    return F.when(exe != "", exe).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def device_strings(strings: Column, most: int = 50) -> Column:
    return F.slice(F.filter(strings, lambda s: s.rlike(DEVICE_PATTERN)), 1, most)


def link_targets(strings: Column, most: int = 20) -> Column:
    return F.slice(F.filter(strings, lambda s: s.rlike(TARGET_PATTERN)), 1, most)


def matched(files: DataFrame, since_ns: int | None = None) -> DataFrame:
    """files with their category; those of no category are left out, and timed kinds from before since_ns."""
    out = files.withColumn("category", evidence.artifact_category(F.col("path"))).where("category IS NOT NULL")
    return out if since_ns is None else out.where(~F.col("category").isin(*TIMED) | (F.col("mtime_ns") >= since_ns))


def prefetches(files: DataFrame) -> DataFrame:
    """path, exe_guess, exe, run_count, last_runs_utc, parse_status of prefetch files (as from matched)."""
    p = files.where("category = 'prefetch'").withColumn("p", parsers.prefetch("content"))
    return p.select("path", exe_guess(paths.basename(F.col("path"))).alias("exe_guess"), F.col("p.exe").alias("exe"), F.col("p.run_count").alias("run_count"), F.transform("p.last_runs", timeutil.filetime_to_iso).alias("last_runs_utc"), F.coalesce("p.status", F.lit("unknown_format")).alias("parse_status"))


def events(files: DataFrame, per_record: int = 6) -> DataFrame:
    """path, at (place in the file), record_id, timestamp_utc, strings of event logs' records."""
    rows = files.select("path", F.posexplode(parsers.evtx_events("content", F.lit(per_record))).alias("at", "e"))
    stamp = F.when(F.col("e.filetime") > 0, timeutil.filetime_to_iso(F.col("e.filetime")))
    return rows.select("path", "at", F.col("e.record_id").alias("record_id"), stamp.alias("timestamp_utc"), F.col("e.strings").alias("strings"))


def timelines(files: DataFrame, records: DataFrame) -> DataFrame:
    """path, status, event_count, first_event_utc, last_event_utc of each log; first and last in file order, not by time.

    records has path, at, timestamp_utc, as from events()."""
    ends = records.groupBy("path").agg(F.count("*").alias("event_count"), F.min_by("timestamp_utc", "at").alias("first_event_utc"), F.max_by("timestamp_utc", "at").alias("last_event_utc"))
    joined = files.select("path").join(ends, "path", "left")
    return joined.select("path", F.when(F.col("event_count") > 0, F.lit("ok")).otherwise(F.lit("no_records")).alias("status"), F.coalesce("event_count", F.lit(0)).alias("event_count"), "first_event_utc", "last_event_utc")


def links(files: DataFrame) -> DataFrame:
    """path, target, accessed_utc, targets_guess of shortcuts."""
    rows = files.where((F.col("category") == "recent_items") & (paths.extension(F.col("path")) == ".lnk")).withColumn("l", parsers.lnk("content"))
    return rows.select("path", F.col("l.target").alias("target"), F.when(F.col("l.accessed") > 0, timeutil.filetime_to_iso(F.col("l.accessed"))).alias("accessed_utc"), link_targets(parsers.strings("content", F.lit(2000))).alias("targets_guess"))


# --- hives: values (path of the hive, key_path, value_name, type_id, data, last_write), one row a key and one a value


def hive_rows(files: DataFrame) -> DataFrame:
    """All keys and values of hive files, with rel, the key's path below the root in lower case."""
    name = F.lower(paths.basename(F.col("path")))
    rows = files.where(name.isin(*evidence.HIVES)).select("path", name.alias("hive"), F.explode(parsers.hive_values("content")).alias("v")).select("path", "hive", "v.*")
    return rows.withColumn("rel", F.lower(F.regexp_replace("key_path", "^[^/]*/?", "")))


def _little(data: Column, at: int, size: int) -> Column:
    """An unsigned number of size bytes, least first; NULL if the data end before it."""
    digits = F.concat(*[F.hex(F.substring(data, at + 1 + k, 1)) for k in reversed(range(size))])
    return F.when(F.length(data) >= at + size, F.conv(digits, 16, 10).cast("decimal(20,0)").try_cast("long"))


def _written(column: str = "last_write") -> Column:
    return F.when(F.col(column) > 0, timeutil.filetime_to_iso(F.col(column)))


def shimcache(rows: DataFrame) -> DataFrame:
    """path, program, how, file_time_utc, control_set, cache_written_utc: programs in each control set's compatibility cache."""
    held = rows.where(F.col("hive").contains("system") & F.col("rel").rlike("^controlset[^/]*/control/session manager/appcompatcache(/appcompatibility)?$") & F.lower("value_name").isin("appcompatcache", "main") & (F.length("data") > 0))
    control = F.regexp_extract("key_path", "^[^/]*/([^/]*)", 1)
    best = Window.partitionBy("path", "control_set").orderBy(F.length("rel"), F.lower("value_name"))  # a few values a control set
    picked = held.withColumn("control_set", control).withColumn("k", F.row_number().over(best)).where("k = 1")
    each = picked.select("path", "control_set", _written().alias("cache_written_utc"), F.explode(parsers.shimcache_entries("data")).alias("e"))
    return each.select("path", F.col("e.path").alias("program"), F.col("e.how").alias("how"), F.when(F.col("e.filetime") > 0, timeutil.filetime_to_iso(F.col("e.filetime"))).alias("file_time_utc"), "control_set", "cache_written_utc")


def usbstor(rows: DataFrame) -> DataFrame:
    """path, device, serial, friendly_name, first_seen_utc, control_set of storage devices that were plugged in."""
    inside = rows.where(F.col("hive").contains("system") & F.col("rel").rlike("^controlset[^/]*/enum/usbstor/[^/]+/[^/]+$"))
    names = inside.where(F.lower("value_name") == "friendlyname").groupBy("path", "key_path").agg(F.min(parsers.hive_text("data", "type_id")).alias("friendly_name"))
    part = lambda k: F.element_at(F.split("key_path", "/"), k)
    return inside.where("value_name IS NULL").join(names, ["path", "key_path"], "left").select("path", part(-2).alias("device"), part(-1).alias("serial"), "friendly_name", _written().alias("first_seen_utc"), part(2).alias("control_set"))


def userassist(rows: DataFrame) -> DataFrame:
    """path, program, run_count, last_run_utc of programs started from the desktop; long records have the time at 60, short ones at 8."""
    held = rows.where(F.col("hive").contains("ntuser") & F.col("rel").rlike("^software/microsoft/windows/currentversion/explorer/userassist/[^/]+/count$") & F.col("value_name").isNotNull())
    size = F.length("data")
    ticks = F.when(size >= 68, _little(F.col("data"), 60, 8)).when(size >= 16, _little(F.col("data"), 8, 8))
    return held.select("path", parsers.rot13(F.col("value_name")).alias("program"), F.when(size >= 16, _little(F.col("data"), 4, 4)).alias("run_count"), F.when(ticks > 0, timeutil.filetime_to_iso(ticks)).alias("last_run_utc"))


def run_keys(rows: DataFrame) -> DataFrame:
    """path, key, value_name, command, written_utc of programs that start by themselves."""
    held = rows.where((F.col("hive").contains("software") | F.col("hive").contains("ntuser")) & F.col("rel").rlike("^(software/)?microsoft/windows/currentversion/run(once)?$") & F.col("value_name").isNotNull())
    return held.select("path", F.element_at(F.split("key_path", "/"), -1).alias("key"), "value_name", parsers.hive_text("data", "type_id").alias("command"), _written().alias("written_utc"))


def recent_documents(rows: DataFrame) -> DataFrame:
    """path, name, folder of documents that a user opened; folder is NULL for the list of all."""
    held = rows.where(F.col("hive").contains("ntuser") & F.col("rel").rlike("^software/microsoft/windows/currentversion/explorer/recentdocs(/[^/]+)?$") & F.col("value_name").isNotNull())
    name = F.trim(F.regexp_extract(F.decode("data", "UTF-16LE"), r"^([^\x00]*)", 1))
    folder = F.when(F.col("rel").rlike("/recentdocs/"), F.element_at(F.split("key_path", "/"), -1))
    return held.select("path", name.alias("name"), folder.alias("folder")).where("name <> ''")


def amcache(rows: DataFrame) -> DataFrame:
    """path, program, sha1, written_utc of the program inventory; a digest is 20 bytes, or a text where it's shorter."""
    inside = rows.where(F.col("hive").contains("amcache") & F.col("rel").rlike("^(file|inventoryapplicationfile)/[^/]+(/[^/]+)?$") & F.col("value_name").isNotNull())
    rank = lambda names: F.array_position(F.array(*map(F.lit, names)), F.lower("value_name"))
    text = parsers.hive_text("data", "type_id")
    sha = F.when(F.length("data") >= 20, F.lower(F.hex(F.substring("data", 1, 20)))).otherwise(text)
    where, digest = rank(("lowercaselongpath", "longpath", "fullpath", "101")), rank(("sha1", "fileid", "17"))
    valued = inside.select("path", "key_path", "last_write", where.alias("w"), digest.alias("d"), text.alias("text"), sha.alias("sha"))
    keys = valued.groupBy("path", "key_path").agg(F.max("last_write").alias("last_write"), F.min_by("text", F.when(F.col("w") > 0, F.col("w"))).alias("program"), F.min_by("sha", F.when(F.col("d") > 0, F.col("d"))).alias("sha1"))
    return keys.where(F.trim("program") != "").select("path", F.trim("program").alias("program"), "sha1", _written().alias("written_utc"))


def observed(files: DataFrame, since_ns: int | None = None) -> DataFrame:
    """label, evidence, path, observed, detail of every sign of a tool: prefetch, links, drivers, hives by name and by what they hold."""
    found = matched(files, since_ns)
    rows = hive_rows(found)
    last = lambda c: F.regexp_extract(c, r"([^\\/]*)$", 1)
    as_text = lambda *cs: F.to_json(F.struct(*cs))
    p, by_name = prefetches(found), evidence.tool_label(paths.basename(F.col("path")))
    label = F.coalesce(evidence.tool_label(F.col("exe_guess")), evidence.tool_label(F.col("exe")), by_name)
    parts = [
        p.select(label.alias("label"), F.lit("prefetch").alias("evidence"), "path", F.coalesce("exe", "exe_guess").alias("observed"), as_text("run_count", "last_runs_utc").alias("detail")),
        links(found).select(evidence.tool_label(last(F.col("target"))).alias("label"), F.lit("recent_link").alias("evidence"), "path", F.col("target").alias("observed"), as_text("accessed_utc").alias("detail")),
        found.where(F.col("category").isin("registry_or_device_log", "drivers")).select(by_name.alias("label"), F.col("category").alias("evidence"), "path", paths.basename(F.col("path")).alias("observed"), F.lit("{}").alias("detail")),
        usbstor(rows).select(F.lit(USB_LABEL).alias("label"), F.lit("usbstor").alias("evidence"), "path", "serial", as_text("device", "friendly_name", "first_seen_utc", "control_set").alias("detail")),
    ]
    for name, held, detail in (("shimcache", shimcache(rows), ("how", "file_time_utc", "control_set")), ("userassist", userassist(rows), ("run_count", "last_run_utc")), ("amcache", amcache(rows), ("sha1", "written_utc"))):
        parts.append(held.select(evidence.tool_label(last(F.col("program"))).alias("label"), F.lit(f"hive_{name}").alias("evidence"), "path", F.col("program").alias("observed"), as_text(*detail).alias("detail")))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.where("label IS NOT NULL")


def tools(signs: DataFrame, most: int = 10) -> DataFrame:
    """label, items, evidence (kinds), samples (the first paths) of each tool that observed() has found."""
    ranked = signs.select("label", "evidence", "path").withColumn("k", F.row_number().over(Window.partitionBy("label", F.pmod(F.xxhash64("path"), F.lit(64))).orderBy("path")))
    sample = ranked.where(f"k <= {most}").groupBy("label").agg(F.slice(F.array_sort(F.collect_list("path")), 1, most).alias("samples"))
    return signs.groupBy("label").agg(F.count("*").alias("items"), F.array_sort(F.collect_set("evidence")).alias("evidence")).join(sample, "label")


def summary(found: DataFrame) -> DataFrame:
    """category, files, bytes of what matched() keeps."""
    return found.groupBy("category").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
