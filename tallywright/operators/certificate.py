"""Consistency checks of an itemised certificate (rows as in schema.CERTIFICATE plus ord, their order in the list)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digests, paths, timeutil
from ..sources import parsers

SAMPLES = 10
#: Check name and severity. Fixed values.
SEVERITY = {"seq_integrity": "warn", "hash_format": "fail", "name_path_mismatch": "warn", "duplicate_sha1": "warn", "duplicate_md5": "warn", "duplicate_sha256": "warn", "duplicate_path": "warn", "post_cert_mtime": "fail", "unparseable_date": "info"}


def _number() -> Column:
    return F.trim("seq").try_cast("long")


def sequence_gaps(rows: DataFrame, key: str | None = None) -> DataFrame:
    """(key), after, next, missing: each gap between neighbouring sequence numbers. key: lists that are numbered apart."""
    keys = [key] if key else []
    seqs = rows.select(*keys, _number().alias("n")).where("n IS NOT NULL").distinct()
    # a single list is numbered in one window; ranges of 10,000 numbers meet at their ends, so that no task sorts the whole list
    block = seqs.withColumn("b", F.floor(F.col("n") / 10_000))
    inside = Window.partitionBy(*keys, "b").orderBy("n")
    stepped = block.withColumn("next", F.lead("n").over(inside))
    ends = block.groupBy(*keys, "b").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    across = Window.partitionBy(*keys).orderBy("b")
    ends = ends.withColumn("following", F.lead("first").over(across)).select(*keys, F.col("last").alias("n"), F.col("following").alias("next"))
    every = stepped.select(*keys, "n", "next").where("next IS NOT NULL").unionByName(ends.where("next IS NOT NULL"))
    return every.where("next > n + 1").select(*keys, F.col("n").alias("after"), "next", (F.col("next") - F.col("n") - 1).alias("missing"))


def sequence_report(rows: DataFrame, key: str) -> DataFrame:
    """One row for each list: rows, non_numeric, repeated, descents (a number below that of the row before), gaps, missing."""
    ordered = rows.withColumn("n", _number())
    back = Window.partitionBy(key).orderBy("ord")
    flags = ordered.withColumn("down", (F.lag("n").over(back) > F.col("n")).cast("int"))
    base = flags.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(F.col("n").isNull()).alias("non_numeric"), (F.count("n") - F.count_distinct("n")).alias("repeated"), F.coalesce(F.sum("down"), F.lit(0)).alias("descents"))
    gaps = sequence_gaps(rows, key).groupBy(key).agg(F.count("*").alias("gaps"), F.sum("missing").alias("missing"))
    return base.join(gaps, key, "left").na.fill(0, ["gaps", "missing"])


def _is_number(seq: Column) -> Column:
    return seq.rlike("^[0-9]+$")


def sequence_issues(rows: DataFrame) -> DataFrame:
    """issue, ord: what is wrong with the numbering of the whole list. non_numeric: one row for each such cell; duplicate,
    gap, descent and non_numeric_cells: one row each, if there is any, with the first place. Empty numbers don't count."""
    seq = F.trim("seq")
    cells = rows.where(seq != "").select("ord", seq.alias("seq"), F.when(_is_number(seq), seq.try_cast("decimal(38,0)")).alias("n"))
    odd = cells.where("n IS NULL").select(F.lit("non_numeric").alias("issue"), "ord")
    numbers = cells.where("n IS NOT NULL").select("ord", "n")
    twice = numbers.groupBy("n").agg(F.count("*").alias("c"), F.min("ord").alias("ord")).where("c > 1")
    gap = sequence_gaps(rows.where(_is_number(seq)).withColumn("_list", F.lit(1)), "_list").select(F.col("after").alias("ord"))
    # a number below the one before it, within blocks of 10,000 places and across their ends
    block = numbers.withColumn("b", F.floor(F.col("ord") / 10_000))
    down = block.withColumn("before", F.lag("n").over(Window.partitionBy("b").orderBy("ord"))).where("n < before").select("ord")
    ends = block.groupBy("b").agg(F.min_by("n", "ord").alias("n"), F.min("ord").alias("ord"), F.max_by("n", "ord").alias("last"))
    across = ends.withColumn("before", F.lag("last").over(Window.orderBy("b"))).where("n < before").select("ord")
    any_of = lambda name, df: df.agg(F.min("ord").alias("ord")).where("ord IS NOT NULL").select(F.lit(name).alias("issue"), F.col("ord").cast(dict(rows.dtypes)["ord"]).alias("ord"))
    return odd.unionByName(any_of("non_numeric_cells", odd)).unionByName(any_of("duplicate", twice)).unionByName(any_of("gap", gap)).unionByName(any_of("descent", down.union(across)))


def duplicates(rows: DataFrame, fields: tuple[str, ...] = ("sha1", "md5", "sha256", "path")) -> DataFrame:
    """field, value, count, first_row of values (lower case, not empty) that several rows have."""
    pairs = rows.select("ord", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.trim(F.col(f))).alias("value")) for f in fields])).alias("x"))
    return pairs.select("ord", "x.*").where("value <> ''").groupBy("field", "value").agg(F.count("*").alias("count"), F.min("ord").alias("first_row")).where("count > 1")


def bad_digests(rows: DataFrame) -> DataFrame:
    """ord, field, value of digests that aren't hex of the field's length."""
    fields = ("md5", "sha1", "sha256")
    pairs = rows.select("ord", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f)).alias("value"), digests.well_formed(F.trim(F.col(f)), f).alias("ok")) for f in fields])).alias("x"))
    return pairs.select("ord", "x.*").where("value <> '' AND NOT ok").drop("ok")


def name_mismatches(rows: DataFrame) -> DataFrame:
    """ord, name, base where the name column isn't the path's last part."""
    base = paths.basename(F.translate(F.trim("path"), "\\", "/"))
    return rows.where((F.trim("name") != "") & (F.trim("path") != "") & (F.trim("name") != base)).select("ord", "name", base.alias("base"))


def issued_at(file_name: Column) -> Column:
    """Time of issue from the fourteen digits in a certificate's file name; NULL without them."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(file_name, r"(?<!\d)(\d{14})(?!\d)", 1), F.lit("")), F.lit("yyyyMMddHHmmss"))


def after_issue(rows: DataFrame, issued: Column) -> DataFrame:
    """Rows whose modification time is later than the certificate."""
    return rows.where(timeutil.lenient_datetime(F.col("modified")) > issued)


def bad_dates(rows: DataFrame) -> DataFrame:
    """ord, field, value of dates that can't be read."""
    fields = ("created", "modified", "accessed")
    pairs = rows.select("ord", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), timeutil.lenient_datetime(F.col(f)).isNull().alias("bad")) for f in fields])).alias("x"))
    return pairs.select("ord", "x.*").where("trim(value) <> '' AND bad").drop("bad")


def findings(rows: DataFrame, issued: Column | None = None) -> DataFrame:
    """check, severity, count, samples (the first ten places) of every check with findings."""
    parts = [
        sequence_issues(rows).select(F.lit("seq_integrity").alias("check"), "ord"),
        bad_digests(rows).select(F.lit("hash_format").alias("check"), "ord"),
        name_mismatches(rows).select(F.lit("name_path_mismatch").alias("check"), "ord"),
        duplicates(rows).select(F.concat(F.lit("duplicate_"), F.col("field")).alias("check"), F.col("first_row").alias("ord")),
        bad_dates(rows).select(F.lit("unparseable_date").alias("check"), "ord"),
    ]
    if issued is not None:
        parts.append(after_issue(rows, issued).select(F.lit("post_cert_mtime").alias("check"), "ord"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    ranked = every.withColumn("k", F.row_number().over(Window.partitionBy("check", F.pmod(F.xxhash64("ord"), F.lit(64))).orderBy("ord")))  # ten of each of 64 parts hold the first ten
    sample = ranked.where(f"k <= {SAMPLES}").groupBy("check").agg(F.slice(F.array_sort(F.collect_list("ord")), 1, SAMPLES).alias("samples"))
    return every.groupBy("check").agg(F.count("*").alias("count")).join(sample, "check").select("check", F.element_at(severity, F.col("check")).alias("severity"), "count", "samples")


def printed_digests(text: Column, name: str = "sha1") -> Column:
    """How many digests of an algorithm a text has, as whole runs of hex digits."""
    n = digests.LENGTHS[name]
    return F.size(F.regexp_extract_all(text, F.lit(rf"(?<![0-9a-fA-F])[0-9a-fA-F]{{{n}}}(?![0-9a-fA-F])"), F.lit(0)))


def reverify(rows: DataFrame, files: DataFrame) -> DataFrame:
    """ord, path, result (match, missing, size_mismatch, hash_mismatch, hash_incomparable) of each row against files with md5, sha1, sha256."""
    claimed = rows.select("ord", paths.normalise(F.col("path")).alias("path"), F.trim("size").try_cast("long").alias("claimed_size"), *[F.nullif(F.lower(F.trim(F.col(n))), F.lit("")).alias(f"c_{n}") for n in ("sha256", "sha1", "md5")])
    joined = claimed.join(files.select("path", "size", *[F.lower(F.col(n)).alias(n) for n in ("sha256", "sha1", "md5")], F.lit(True).alias("here")), "path", "left")
    differs, compared = F.lit(False), F.lit(False)
    for n in ("sha256", "sha1", "md5"):
        both = F.col(f"c_{n}").isNotNull() & F.col(n).isNotNull()
        differs, compared = differs | (both & (F.col(f"c_{n}") != F.col(n))), compared | both
    result = F.when(F.col("here").isNull(), F.lit("missing")).when(F.col("claimed_size") != F.col("size"), F.lit("size_mismatch")).when(F.coalesce(differs, F.lit(False)), F.lit("hash_mismatch")).when(compared, F.lit("match")).otherwise(F.lit("hash_incomparable"))
    return joined.select("ord", "path", result.alias("result"))


# --- a delivered package: list, forms and printed copies together

#: Words in the names of a package's parts. Fixed values.
DETAIL_NAMES = ("상세목록", "detail")
FORM_NAMES = ("서식", "확인서")
SYSTEM_NAME = "시스템정보"


def members(files: DataFrame) -> DataFrame:
    """member, role, content of packages (path, content): archives opened, one level of archives inside them looked into.

    role: xlsx (the list), detail_pdf (its printed copy), form_pdf (the certificate itself), sysinfo or other."""
    name, base = F.lower("member"), paths.basename(F.col("member"))
    has = lambda text, words: F.exists(F.array(*map(F.lit, words)), text.contains)
    role = (
        F.when(name.endswith(".xlsx"), F.lit("xlsx"))
        .when(name.endswith(".pdf") & (base.contains(DETAIL_NAMES[0]) | name.contains(DETAIL_NAMES[1])), F.lit("detail_pdf"))
        .when(name.endswith(".pdf") & has(base, FORM_NAMES), F.lit("form_pdf"))
        .when(~name.endswith(".pdf") & (F.col("member").contains(SYSTEM_NAME) | name.endswith(".zip")), F.lit("sysinfo"))
        .otherwise(F.lit("other"))
    )
    opened = files.select(F.explode(parsers.zip_members("content", paths.basename(F.col("path")))).alias("m"))
    return opened.select(F.col("m.name").alias("member"), F.col("m.content").alias("content")).withColumn("role", role)


def package_rows(parts: DataFrame) -> DataFrame:
    """Rows of all lists in a package, with ord, their order over lists in name order and rows in theirs."""
    rows = parts.where("role = 'xlsx'").select("member", F.posexplode(parsers.read_xlsx("content")).alias("at", "r")).select("member", "at", "r.*")
    sizes = rows.groupBy("member").agg(F.count("*").alias("_n"))  # one row a list
    before = F.coalesce(F.sum("_n").over(Window.orderBy("member").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("member", before.alias("_before")), "member").withColumn("ord", F.col("_before") + F.col("at")).drop("_before", "at")


def printed_check(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """check, severity, count: how many digests the printed copies have against the rows with one; no row without a printed copy.

    detail_pdf_text: the copies have no text. detail_pdf_crosscheck: the difference, ok only if there is none."""
    texts = parts.where("role = 'detail_pdf'").select(F.trim(F.coalesce(parsers.extract_text("content", F.lit(".pdf")), F.lit(""))).alias("t"))
    printed = texts.agg(F.count("*").alias("copies"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars"), F.coalesce(F.sum(printed_digests(F.col("t"))), F.lit(0)).alias("printed"))
    hashed = rows.agg(F.count_if((F.trim("sha1") != "") | (F.trim("sha256") != "") | (F.trim("md5") != "")).alias("hashed"))
    gap = F.abs(F.col("printed") - F.col("hashed"))
    both = printed.crossJoin(hashed).where("copies > 0")  # one row each
    check = F.when(F.col("chars") == 0, F.lit("detail_pdf_text")).otherwise(F.lit("detail_pdf_crosscheck"))
    severity = F.when(F.col("chars") == 0, F.lit("info")).when(gap == 0, F.lit("ok")).otherwise(F.lit("warn"))
    return both.select(check.alias("check"), severity.alias("severity"), F.when(F.col("chars") == 0, F.lit(1)).otherwise(gap).cast("long").alias("count"))


def live_stats(rows: DataFrame, files: DataFrame) -> DataFrame:
    """One row: resolved, missing, size_match, size_mismatch, hash_verified, hash_mismatch, hash_skipped of rows with a path.

    Sizes are compared by their digits, digests by the strongest that the row has."""
    size = F.nullif(F.regexp_replace("size", "[^0-9]", ""), F.lit("")).try_cast("long")
    held = lambda n: F.nullif(F.lower(F.trim(F.col(n))), F.lit(""))
    algo = F.coalesce(*[F.when(held(n).isNotNull(), F.lit(n)) for n in ("sha256", "sha1", "md5")])
    claimed = rows.where(F.trim("path") != "").select(paths.normalise(F.trim("path")).alias("path"), size.alias("claimed_size"), algo.alias("algo"), F.coalesce(*[held(n) for n in ("sha256", "sha1", "md5")]).alias("claim"))
    now = files.select("path", F.col("size").alias("now_size"), *[F.lower(F.col(n)).alias(f"now_{n}") for n in ("sha256", "sha1", "md5")], F.lit(True).alias("here"))
    actual = F.coalesce(*[F.when(F.col("algo") == n, F.col(f"now_{n}")) for n in ("sha256", "sha1", "md5")])
    j = claimed.join(now, "path", "left").withColumn("actual", actual)
    tests = {
        "resolved": "here", "missing": "here IS NULL", "size_match": "here AND claimed_size = now_size", "size_mismatch": "here AND claimed_size <> now_size",
        "hash_verified": "here AND claim = actual", "hash_mismatch": "here AND claim <> actual", "hash_skipped": "here AND claim IS NOT NULL AND actual IS NULL",
    }
    return j.agg(*[F.count_if(F.expr(t)).alias(n) for n, t in tests.items()])


def package_findings(parts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """check, severity, count of everything that is wrong with a package (as from members()); files: those on the returned disk."""
    rows = package_rows(parts)
    form = parts.where("role = 'form_pdf'").agg(F.max(issued_at(paths.basename(F.col("member")))).alias("t")).first()["t"]
    out = findings(rows, F.lit(form) if form is not None else None).select("check", "severity", "count")
    none = parts.agg(F.count_if(F.col("role") == "xlsx").alias("n")).where("n = 0")
    out = out.unionByName(none.select(F.lit("no_detail_xlsx").alias("check"), F.lit("info").alias("severity"), F.lit(1).cast("long").alias("count")))
    out = out.unionByName(printed_check(parts, rows))
    if files is not None:
        wrong = F.col("size_mismatch") + F.col("hash_mismatch")
        out = out.unionByName(live_stats(rows, files).where(wrong > 0).select(F.lit("live_reverify").alias("check"), F.lit("fail").alias("severity"), wrong.alias("count")))
    return out


def package_summary(parts: DataFrame, found: DataFrame) -> DataFrame:
    """One row: rows, seq_first, seq_last of the lists; findings, fail, warn."""
    seq = F.trim("seq")
    rows = package_rows(parts).agg(F.count("*").alias("rows"), F.min(F.when(_is_number(seq), seq.try_cast("long"))).alias("seq_first"), F.max(F.when(_is_number(seq), seq.try_cast("long"))).alias("seq_last"))
    return rows.crossJoin(found.agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "fail").alias("fail"), F.count_if(F.col("severity") == "warn").alias("warn")))
