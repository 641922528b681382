"""Every query of the library by name, with the equivalent SQL where there is one.

The driver's tables hold no inventories, so documents, orders and others are read as such: each row is a file or a claim. Rows are
perturbed by rules on their keys to make two snapshots, right and wrong claims; no row is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import digests, paths, reasons, timeutil
from .operators import artifacts, audit, boundary, certificate, custody, diff, evidence, inventory, journal, procedure, resolve, scan, verify
from .plans.criteria import Keyword, Profile, evaluate
from .session import shared_folder, ship
from .sources import claims as claim_lists
from .sources import delivery, parsers
from .streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
T0 = 1_700_000_000_000_000_000


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILE_COLUMNS = ("path", "size", "mtime_ns", "ctime_ns", "atime_ns", "sha256", "kind", "status")
BASE = f"""
  SELECT doc_id, text, concat('docs/', source, '/', lang, '/', CAST(doc_id AS STRING), '.txt') AS path, n_chars AS size,
         {T0} + doc_id * 1000000000 AS mtime_ns, {T0} + doc_id * 1000000000 AS ctime_ns, {T0} + doc_id * 1000000000 AS atime_ns,
         CASE WHEN doc_id % 29 = 0 THEN NULL ELSE SHA256(text) END AS sha256, 'file' AS kind, CASE WHEN doc_id % 29 = 0 THEN 'read_error' ELSE 'ok' END AS status
  FROM documents"""
CURRENT = f"""
  SELECT doc_id, text, concat(CASE WHEN doc_id % 17 = 0 THEN 'moved/' ELSE 'docs/' END, source, '/', lang, '/', CAST(doc_id AS STRING), '.txt') AS path, n_chars + CASE WHEN doc_id % 31 = 0 THEN 1 ELSE 0 END AS size,
         {T0} + doc_id * 1000000000 + CASE WHEN doc_id % 7 = 0 THEN 5000000000 ELSE 0 END AS mtime_ns, {T0} + doc_id * 1000000000 AS ctime_ns,
         {T0} + doc_id * 1000000000 + CASE WHEN doc_id % 5 = 0 THEN 9000000000 ELSE 0 END AS atime_ns,
         CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN SHA256(concat(text, 'x')) ELSE SHA256(text) END AS sha256,
         CASE WHEN doc_id % 23 = 0 THEN 'dir' ELSE 'file' END AS kind, 'ok' AS status
  FROM documents"""
#: Claims: exact path, suffix of a path, windows spelling, unknown path; digests right, wrong, of another algorithm or none.
CLAIMS = """
  SELECT doc_id AS ord,
         CASE WHEN doc_id % 4 = 0 THEN concat('docs/', source, '/', lang, '/', CAST(doc_id AS STRING), '.txt') WHEN doc_id % 4 = 1 THEN concat(lang, '/', CAST(doc_id AS STRING), '.txt')
              WHEN doc_id % 4 = 2 THEN concat('C:/docs/', source, '//', lang, '/', CAST(doc_id AS STRING), '.txt') ELSE concat('gone/', CAST(doc_id AS STRING), '.bin') END AS claimed_path,
         CASE WHEN doc_id % 4 = 0 THEN concat('docs/', source, '/', lang, '/', CAST(doc_id AS STRING), '.txt') WHEN doc_id % 4 = 1 THEN concat(lang, '/', CAST(doc_id AS STRING), '.txt')
              WHEN doc_id % 4 = 2 THEN concat('docs/', source, '/', lang, '/', CAST(doc_id AS STRING), '.txt') ELSE concat('gone/', CAST(doc_id AS STRING), '.bin') END AS rel,
         CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN MD5(text) WHEN doc_id % 9 = 2 THEN SHA256(concat(text, '!')) ELSE SHA256(text) END AS digest,
         doc_id % 37 = 0 AS unparsed
  FROM documents"""


def spark_sql(sql: str) -> str:
    return sql.replace("SHA256(text)", "sha2(text, 256)").replace("SHA256(concat(text, 'x'))", "sha2(concat(text, 'x'), 256)").replace("SHA256(concat(text, '!'))", "sha2(concat(text, '!'), 256)")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(spark_sql(sql).replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def base(spark, sf_dir):
    return view(spark, sf_dir, BASE).select(*FILE_COLUMNS)


def current(spark, sf_dir):
    return view(spark, sf_dir, CURRENT).select(*FILE_COLUMNS)


def claims(spark, sf_dir):
    return view(spark, sf_dir, CLAIMS).withColumn("hash_algo", digests.algorithm(F.col("digest")))


CHANGED = f"""WITH base AS ({BASE}), cur AS ({CURRENT}), d AS (
  SELECT coalesce(b.path, a.path) AS path, a.path AS ap, b.path AS bp, a.kind AS akind, a.mtime_ns AS amtime,
    CASE WHEN b.path IS NULL OR a.path IS NULL THEN NULL
      WHEN a.kind IS DISTINCT FROM b.kind THEN 'kind_changed'
      WHEN b.sha256 IS NOT NULL AND a.sha256 IS NOT NULL AND a.sha256 <> b.sha256 THEN 'content_changed'
      WHEN b.sha256 IS NOT NULL AND a.sha256 IS NOT NULL AND a.atime_ns <> b.atime_ns AND a.mtime_ns = b.mtime_ns THEN 'accessed'
      WHEN b.sha256 IS NOT NULL AND a.sha256 IS NOT NULL AND (a.mtime_ns <> b.mtime_ns OR a.ctime_ns <> b.ctime_ns OR a.size <> b.size OR a.atime_ns <> b.atime_ns) THEN 'metadata_changed'
      WHEN b.sha256 IS NOT NULL AND a.sha256 IS NOT NULL THEN 'unchanged'
      WHEN a.status <> b.status THEN 'status_changed'
      WHEN a.mtime_ns <> b.mtime_ns OR a.ctime_ns <> b.ctime_ns OR a.size <> b.size THEN 'modified_unverifiable'
      ELSE 'unchanged_unverifiable' END AS class
  FROM base b FULL OUTER JOIN cur a ON a.path = b.path), changes AS (
  SELECT path, CASE WHEN bp IS NULL THEN 'added' WHEN ap IS NULL THEN 'removed' WHEN class IN ('unchanged', 'unchanged_unverifiable') THEN 'unchanged' ELSE 'changed' END AS change, class,
    bp IS NULL AND akind = 'file' AND amtime > 0 AND amtime < {T0 + 500_000_000_000} AS backdated FROM d)
"""


def changes(spark, sf_dir):
    return diff.diff(base(spark, sf_dir), current(spark, sf_dir), T0 + 500_000_000_000)


@query(CHANGED + "SELECT path, change, class, backdated FROM changes")
def snapshot_diff(spark, sf_dir):
    return changes(spark, sf_dir).select("path", "change", "class", "backdated")


@query(CHANGED + "SELECT " + ", ".join([f"count(*) FILTER (WHERE {t}) AS {n}" for n, t in [("added", "change = 'added'"), ("removed", "change = 'removed'"), ("backdated", "backdated"), *[(c, f"class = '{c}'") for c in diff.CHANGE_CLASSES]]]) + " FROM changes")
def diff_summary(spark, sf_dir):
    return diff.summary(changes(spark, sf_dir))


@query(CHANGED + "SELECT path FROM changes WHERE backdated")
def backdated_added(spark, sf_dir):
    return changes(spark, sf_dir).where("backdated").select("path")


@query(f"""WITH base AS ({BASE}), cur AS ({CURRENT}), j AS (SELECT a.path, a.kind, p.sha256, a.status,
    coalesce(a.size = p.size AND a.mtime_ns = p.mtime_ns AND a.kind = p.kind AND p.sha256 IS NOT NULL AND p.status = 'ok', false) AS reused FROM cur a LEFT JOIN base p ON a.path = p.path)
  SELECT path, CASE WHEN reused THEN sha256 END AS sha256, reused, kind = 'file' AND NOT reused AS to_hash FROM j""")
def incremental_reuse(spark, sf_dir):
    return inventory.reuse_digests(current(spark, sf_dir), base(spark, sf_dir)).select("path", "sha256", "reused", "to_hash")


@query(f"""WITH base AS ({BASE}), cur AS ({CURRENT}), j AS (SELECT a.*, p.sha256 AS old, coalesce(a.size = p.size AND a.mtime_ns = p.mtime_ns AND a.kind = p.kind AND p.sha256 IS NOT NULL AND p.status = 'ok', false) AS reused
    FROM cur a LEFT JOIN base p ON a.path = p.path)
  SELECT path, size, mtime_ns, kind, reused, CASE WHEN reused THEN old WHEN kind = 'file' THEN SHA256(CASE WHEN doc_id % 11 = 0 THEN concat(text, 'x') ELSE text END) END AS sha256 FROM j""")
def incremental_inventory(spark, sf_dir):
    """An inventory brought up to date: unchanged records keep their digest, contents are only read for the others."""
    contents = view(spark, sf_dir, CURRENT).select("path", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("content"))

    def digest(rows: DataFrame) -> DataFrame:
        return rows.drop("sha256").join(contents, "path", "left").withColumn("sha256", F.sha2("content", 256))

    return inventory.refreshed(current(spark, sf_dir), base(spark, sf_dir), digest).select("path", "size", "mtime_ns", "kind", "reused", "sha256")


@query(f"WITH cur AS ({CURRENT}) SELECT kind, count(*) AS count FROM cur GROUP BY kind")
def inventory_counts(spark, sf_dir):
    return inventory.counts(current(spark, sf_dir))


PROFILE = Profile(
    keywords=(Keyword("src1"), Keyword("ingly", where="content")),
    extensions=(".txt", ".hwp"),
    filename_patterns=("1*.txt", "*[02468].txt"),
    date_ranges=(("mtime", T0, T0 + 400_000_000_000), ("atime", T0 + 100_000_000_000, None)),
    path_exclude=("docs/src3/*",),
    size_min=200,
    size_max=4000,
    hash_sets=("toxic",),
)
SCOPE = f"""WITH base AS ({BASE}), sets AS (SELECT DISTINCT b.sha256 FROM base b JOIN labels l ON l.doc_id = b.doc_id WHERE l.toxic = 1 AND b.sha256 IS NOT NULL), g AS (
  SELECT b.path, b.path LIKE 'docs/src3/%' AS excluded, true AS g1, regexp_matches(b.path, '/1[^/]*$') OR regexp_matches(b.path, '[02468][.]txt$') AS g2,
    CASE WHEN contains(b.path, 'src1') THEN true WHEN text IS NULL THEN NULL ELSE contains(lower(text), 'ingly') END AS g3,
    CASE WHEN atime_ns >= {T0 + 100_000_000_000} THEN true ELSE mtime_ns BETWEEN {T0} AND {T0 + 400_000_000_000} END AS g4,
    coalesce(size, 0) BETWEEN 200 AND 4000 AS g6, CASE WHEN b.sha256 IS NULL THEN NULL ELSE s.sha256 IS NOT NULL END AS g7
  FROM base b LEFT JOIN sets s ON s.sha256 = b.sha256), v AS (SELECT *, g2 AND coalesce(g3, true) AND g4 AND g6 AND coalesce(g7, true) AS narrow FROM g)
"""
VERDICT = "CASE WHEN excluded THEN 'excluded' WHEN narrow AND (g3 IS NULL OR g7 IS NULL) THEN 'in_scope_partial' WHEN narrow THEN 'in_scope' ELSE 'borderline' END"


def judged(spark, sf_dir):
    docs = view(spark, sf_dir, BASE)
    toxic = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id").select(F.col("sha256").alias("digest"))
    return evaluate(docs, PROFILE, content="text", hash_sets=toxic)


@query(SCOPE + f"SELECT path, {VERDICT} AS verdict, narrow AND NOT excluded AS narrow, NOT excluded AS broad FROM v")
def scope_verdicts(spark, sf_dir):
    return judged(spark, sf_dir).select("path", "verdict", "narrow", "broad")


@query(SCOPE + f"SELECT {VERDICT} AS verdict, count(*) AS files FROM v GROUP BY 1")
def scan_summary(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("files"))


@query(SCOPE.replace("b.path, b.path LIKE", "b.path, b.status, b.size, b.text, b.path LIKE") + f""", j AS (SELECT *, {VERDICT} AS verdict, text IS NOT NULL AS got FROM v)
  SELECT count(*) AS evaluated, count(*) FILTER (WHERE excluded) AS excluded, count(*) FILTER (WHERE verdict NOT IN ('excluded', 'unverifiable')) AS hits, count(*) FILTER (WHERE verdict = 'in_scope') AS in_scope, count(*) FILTER (WHERE verdict = 'in_scope_partial') AS in_scope_partial,
    count(*) FILTER (WHERE verdict = 'borderline') AS borderline, count(*) FILTER (WHERE status = 'read_error') AS errors, count(*) FILTER (WHERE size <= 5000 AND got) AS content_extracted, count(*) FILTER (WHERE size <= 5000 AND NOT got) AS content_extract_failed, count(*) FILTER (WHERE size > 5000) AS content_not_evaluated,
    0 AS unverifiable, 1 AS content_keyword_terms, count(*) FILTER (WHERE status = 'ok') AS status_ok, count(*) FILTER (WHERE status = 'read_error') AS status_read_error FROM j""")
def scan_counters(spark, sf_dir):
    docs = view(spark, sf_dir, BASE)
    toxic = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id").select(F.col("sha256").alias("digest"))
    row = scan.counters(docs, PROFILE, content="text", hash_sets=toxic, extractable=5000)
    return row.withColumns({f"status_{n}": F.coalesce(F.try_element_at("statuses", F.lit(n)), F.lit(0)) for n in ("ok", "read_error")}).drop("statuses")


@query(f"WITH base AS ({BASE}), h AS (SELECT path, doc_id, size FROM base WHERE size <= 3000 OR contains(path, 'src1')) SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS seq FROM h")
def scan_hits(spark, sf_dir):
    return scan.scan(base(spark, sf_dir), Profile(keywords=(Keyword("src1"),), size_max=3000)).select("path", "seq")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN b >= 820454400000000000 AND b <= 852076800000000000 OR a >= 725846400000000000 AND a <= 757382400000000000 THEN 'true' ELSE 'false' END AS date_ranges
  FROM (SELECT o_orderkey, o_orderstatus, epoch_us(o_orderdate) * 1000 AS a, epoch_us(o_orderdate) * 1000 + 1 AS b FROM orders)""")
def date_range_fold(spark, sf_dir):
    from .plans.criteria import group_columns

    profile = Profile(date_ranges=(("mtime", 725846400000000000, 757382400000000000), ("ctime", 820454400000000000, 852076800000000000)))
    ns = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    times = {"mtime": ns, "ctime": F.when(F.col("o_orderstatus") != "P", ns + 1)}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(group_columns(profile, F.lit("x"), F.lit(0), times)["date_ranges"].cast("string"), F.lit("unknown")).alias("date_ranges"))


@query(r"""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(concat('C:\', replace(url, '/', '\')), '\\', '/', 'g'), '/{2,}', '/', 'g'), '^[A-Za-z]:/', '') AS rel FROM pages)
  SELECT page_id, rel, regexp_extract(rel, '[^/]*$') AS base, CASE WHEN contains(regexp_extract(rel, '[^/]*$'), '.') THEN lower(regexp_extract(rel, '[.][^./]*$')) ELSE '' END AS ext FROM n""")
def path_normalise(spark, sf_dir):
    rel = paths.normalise(F.concat(F.lit("C:\\"), F.translate("url", "/", "\\")))
    return table(spark, sf_dir, "pages").select("page_id", rel.alias("rel")).select("page_id", "rel", paths.basename(F.col("rel")).alias("base"), paths.extension(F.col("rel")).alias("ext"))


RESOLVED = f"""WITH base AS ({BASE}), claims AS ({CLAIMS}), tails AS (
  SELECT path, array_to_string(list_slice(string_split(path, '/'), i, 99), '/') AS tail FROM (SELECT path, unnest(range(2, len(string_split(path, '/')) + 1)) AS i FROM base)),
  hits AS (SELECT tail, count(*) AS n, min(path) AS p FROM tails GROUP BY tail),
  resolved AS (SELECT c.*, coalesce(b.path, CASE WHEN h.n = 1 THEN h.p END) AS matched_path, CASE WHEN b.path IS NOT NULL THEN 'exact' WHEN h.n = 1 THEN 'suffix' END AS tier,
    CASE WHEN b.path IS NULL THEN coalesce(h.n, 0) ELSE 0 END AS suffix_hits FROM claims c LEFT JOIN base b ON b.path = c.rel LEFT JOIN hits h ON h.tail = c.rel)
"""


@query(RESOLVED + "SELECT ord, matched_path, tier, suffix_hits FROM resolved")
def resolve_paths(spark, sf_dir):
    return resolve.exact_and_suffix(claims(spark, sf_dir), base(spark, sf_dir)).select("ord", "matched_path", "tier", "suffix_hits")


@query()
def resolve_similar(spark, sf_dir):
    """Every page's address as a scanner might read it, against all addresses; difflib has no SQL counterpart."""
    pages = table(spark, sf_dir, "pages")
    rel = paths.normalise(F.col("url"))
    files = pages.select(rel.alias("path")).distinct()
    noisy = pages.select(F.translate(rel, "oil", "01|").alias("rel"))
    return resolve.fuzzy(noisy, files)


def stored(spark, sf_dir):
    """Documents as files of unlike names."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12), F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))


@query()
def resolve_damaged(spark, sf_dir):
    """Every document's path with a wrong letter, two in some, against all paths; difflib has no SQL counterpart."""
    files = stored(spark, sf_dir)
    once = F.overlay("path", F.lit("x"), (F.col("doc_id") % 8 + 3).cast("int"))
    damaged = F.when(F.col("doc_id") % 10 == 0, F.overlay(once, F.lit("y"), F.lit(14))).otherwise(once)
    return resolve.fuzzy(files.select(damaged.alias("rel")), files.select("path"))


@query()
def resolve_scoped(spark, sf_dir):
    """Claims with a misread file name, searched for in the deepest folder above them that exists."""
    files = base(spark, sf_dir).withColumn("path", F.concat(F.lit("docs/"), F.substring(F.md5("path"), 1, 2), F.lit("/"), F.substring_index("path", "/", -3)))
    folders = files.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    claimed = files.select(F.when(F.crc32(F.col("path").cast("binary")) % 3 == 0, F.regexp_replace("path", "txt$", "tx7")).otherwise(F.col("path")).alias("rel"))
    return resolve.scoped(claimed, files, folders)


def results(spark, sf_dir):
    return verify.verify(claims(spark, sf_dir), base(spark, sf_dir), Profile(extensions=(".txt",), filename_patterns=("*[13579].txt",), size_max=3000))


VERIFIED = RESOLVED + """, verified AS (SELECT r.ord, r.claimed_path, r.digest, r.matched_path, r.tier,
    CASE WHEN unparsed THEN 'unparsed_item' WHEN matched_path IS NULL THEN CASE WHEN suffix_hits > 1 THEN 'ambiguous_path' ELSE 'not_in_inventory' END
      WHEN r.digest IS NULL OR length(r.digest) <> 64 THEN 'verified' WHEN b.sha256 IS NULL THEN 'unverifiable' WHEN b.sha256 <> r.digest THEN 'hash_mismatch' ELSE 'verified' END AS status,
    CASE WHEN unparsed OR matched_path IS NULL THEN 'unknown' WHEN regexp_matches(b.path, '[13579][.]txt$') AND b.size <= 3000 THEN 'in_scope' ELSE 'borderline' END AS scope_verdict,
    coalesce(NOT unparsed AND matched_path IS NOT NULL AND r.digest IS NOT NULL AND length(r.digest) <> 64, false) AS hash_incomparable,
    NOT unparsed AND matched_path IS NOT NULL AND r.digest IS NULL AS no_claimed_hash
  FROM resolved r LEFT JOIN base b ON b.path = r.matched_path)
"""


@query(VERIFIED + "SELECT ord, matched_path, status, scope_verdict, hash_incomparable, no_claimed_hash FROM verified")
def verify_status(spark, sf_dir):
    return results(spark, sf_dir).select("ord", "matched_path", "status", "scope_verdict", "hash_incomparable", "no_claimed_hash")


@query(VERIFIED + "SELECT count(*) AS items, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in verify.VERIFY_STATUSES) + ", count(*) FILTER (WHERE hash_incomparable) AS hash_incomparable, count(*) FILTER (WHERE no_claimed_hash) AS no_claimed_hash, count(*) FILTER (WHERE tier = 'live') AS missing_now, count(*) FILTER (WHERE tier = 'fuzzy') AS fuzzy_matched, count(*) FILTER (WHERE scope_verdict = 'in_scope') AS scope_in_scope, count(*) FILTER (WHERE scope_verdict = 'in_scope_partial') AS scope_in_scope_partial, count(*) FILTER (WHERE scope_verdict = 'borderline') AS scope_borderline, count(*) FILTER (WHERE scope_verdict = 'out_of_scope') AS scope_out_of_scope, count(*) FILTER (WHERE scope_verdict = 'unverifiable') AS scope_unverifiable, count(*) FILTER (WHERE scope_verdict = 'unknown') AS scope_unknown FROM verified")
def verify_summary(spark, sf_dir):
    return verify.summary(results(spark, sf_dir))


TERMS = ["1", "22", "TXT", "bin", "nothing"]
_LOST, _NOISE = "status IN ('not_in_inventory', 'ambiguous_path', 'unparsed_item')", "scope_verdict IN ('out_of_scope', 'excluded', 'borderline')"


@query(VERIFIED + f""", terms AS (SELECT unnest({TERMS!r}) AS term), a AS (SELECT t.term, v.* FROM terms t LEFT JOIN verified v ON contains(lower(regexp_extract(v.claimed_path, '[^/]*$')), lower(t.term)))
  SELECT term, count(ord) AS seized, count(*) FILTER (WHERE ord IS NOT NULL AND NOT {_LOST} AND scope_verdict = 'in_scope') AS in_scope, count(*) FILTER (WHERE NOT {_LOST} AND {_NOISE}) AS out_of_scope,
    count(*) FILTER (WHERE NOT {_LOST} AND scope_verdict IN ('unverifiable', 'unknown')) AS unverifiable, count(*) FILTER (WHERE {_LOST}) AS missing, CASE WHEN count(ord) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE NOT {_LOST} AND {_NOISE}) / count(ord), 4) END AS noise_ratio FROM a GROUP BY term""")
def keyword_audit(spark, sf_dir):
    return audit.keyword_audit(results(spark, sf_dir), TERMS).select("term", "seized", "in_scope", "out_of_scope", "unverifiable", "missing", "noise_ratio")


_AUDITED = f""", terms AS (SELECT unnest({TERMS!r}) AS term, unnest(range({len(TERMS)})) AS ord), a AS (SELECT t.term, t.ord AS term_ord, v.* FROM terms t LEFT JOIN verified v ON contains(lower(regexp_extract(v.claimed_path, '[^/]*$')), lower(t.term))),
  k AS (SELECT term, term_ord, count(ord) AS seized, count(*) FILTER (WHERE NOT {_LOST} AND {_NOISE}) AS noise FROM a GROUP BY term, term_ord)"""


@query(VERIFIED + _AUDITED + """ SELECT sum(seized)::BIGINT AS attributed, sum(noise)::BIGINT AS noise, (SELECT count(*) FROM verified) AS items, (SELECT count(*) FROM verified WHERE ord NOT IN (SELECT ord FROM a WHERE ord IS NOT NULL)) AS unattributed, coalesce(round(sum(noise) / nullif(sum(seized), 0), 4), 0) AS noise_ratio FROM k""")
def audit_overall(spark, sf_dir):
    return audit.overall(results(spark, sf_dir), TERMS)


@query(VERIFIED + _AUDITED + " SELECT term, round(noise / seized, 4) AS noise_ratio FROM k WHERE seized > 0 ORDER BY round(noise / seized, 4) DESC, seized DESC, term_ord LIMIT 1")
def worst_keyword(spark, sf_dir):
    return audit.worst(audit.keyword_audit(results(spark, sf_dir), TERMS))


@query(RESOLVED + f""", cur AS ({CURRENT}), judged AS (SELECT r.ord, r.claimed_path, r.digest, r.matched_path, b.sha256 AS held, b.size, a.path IS NOT NULL AS present, a.sha256 AS now, r.matched_path IS NOT NULL AND NOT r.unparsed AS matched,
    CASE WHEN unparsed THEN 'unparsed_item' WHEN matched_path IS NULL THEN CASE WHEN suffix_hits > 1 THEN 'ambiguous_path' ELSE 'not_in_inventory' END
      WHEN r.digest IS NULL OR length(r.digest) <> 64 THEN 'verified' WHEN b.sha256 IS NULL THEN 'unverifiable' WHEN b.sha256 <> r.digest THEN 'hash_mismatch' ELSE 'verified' END AS before,
    regexp_matches(b.path, '[13579][.]txt$') OR b.size <= 3000 AS some_group
  FROM resolved r LEFT JOIN base b ON b.path = r.matched_path LEFT JOIN cur a ON a.path = r.matched_path),
  v AS (SELECT *, CASE WHEN before = 'verified' AND now <> held THEN 'hash_mismatch' ELSE before END AS status, before = 'verified' AND NOT present AS missing_now FROM judged),
  {CHANGED.replace("WITH base AS (" + BASE + "), cur AS (" + CURRENT + "), ", "").rstrip()},
  listed AS (SELECT 'out_of_scope' AS section, ord, claimed_path AS path, status FROM v WHERE matched AND NOT some_group UNION ALL SELECT 'absent_now', ord, claimed_path, status FROM v WHERE missing_now
    UNION ALL SELECT 'origin_unknown', ord, claimed_path, status FROM v WHERE status IN ('ambiguous_path', 'not_in_inventory', 'unverifiable', 'unparsed_item') UNION ALL SELECT 'backdated', NULL, path, 'added' FROM changes WHERE change = 'added' AND backdated)
  SELECT section, row_number() OVER (PARTITION BY section ORDER BY ord NULLS FIRST, path) AS no, ord, path, status FROM listed""")
def disposal_lists(spark, sf_dir):
    live = current(spark, sf_dir).select("path", "sha256", *[F.lit(None).cast("string").alias(n) for n in digests.LENGTHS if n != "sha256"])
    checked = verify.verify(claims(spark, sf_dir), base(spark, sf_dir), Profile(filename_patterns=("*[13579].txt",), size_max=3000), live=live)
    return custody.numbered_lists(custody.disposal_lists(checked, changes(spark, sf_dir))).select("section", "no", "ord", "path", "status")


PETITION = ORACLE_SQL["disposal_lists"].rpartition("listed AS (")[0].rstrip().rstrip(",")


def checked_now(spark, sf_dir):
    """Claims against the inventory and against the files as they are now."""
    live = current(spark, sf_dir).select("path", "sha256", *[F.lit(None).cast("string").alias(n) for n in digests.LENGTHS if n != "sha256"])
    return verify.verify(claims(spark, sf_dir), base(spark, sf_dir), Profile(filename_patterns=("*[13579].txt",), size_max=3000), live=live)


@query(PETITION + """, p AS (SELECT 1 AS list, * FROM v WHERE matched AND NOT some_group UNION ALL SELECT 2, * FROM v WHERE missing_now)
  SELECT row_number() OVER (ORDER BY list, ord, claimed_path) AS no, claimed_path, substr(digest, 1, 20) AS digest_start, status, CASE WHEN NOT matched THEN 'unknown' WHEN NOT some_group THEN 'out_of_scope' WHEN regexp_matches(matched_path, '[13579][.]txt$') AND NOT size_over THEN 'in_scope' ELSE 'borderline' END AS scope_verdict FROM p""".replace("size_over", "coalesce(size > 3000, false)"))
def petition_items(spark, sf_dir):
    return custody.petition_items(checked_now(spark, sf_dir))


@query(PETITION + """ SELECT 'items' AS ground, count(*)::DOUBLE AS value, NULL::VARCHAR AS term FROM v UNION ALL SELECT 'out_of_scope', count(*), NULL FROM v WHERE matched AND NOT some_group HAVING count(*) > 0 UNION ALL SELECT 'absent_now', count(*), NULL FROM v WHERE missing_now HAVING count(*) > 0
  UNION ALL SELECT 'changed', count(*), NULL FROM changes WHERE class IN ('modified_unverifiable', 'content_changed') HAVING count(*) > 0 UNION ALL SELECT 'removed', count(*), NULL FROM changes WHERE change = 'removed' HAVING count(*) > 0""")
def petition_grounds(spark, sf_dir):
    return custody.petition_grounds(checked_now(spark, sf_dir), changes(spark, sf_dir))


#: Places named by documents' own columns; some quoted.
SPOTS = "CASE doc_id % 7 WHEN 0 THEN concat('\\\\srv\\', source) WHEN 1 THEN concat('C:\\Users\\OneDrive - ', lang, '\\', source) WHEN 2 THEN concat('\"D:\\XboxGaming\\', source, '\"') WHEN 3 THEN concat('e:\\', source) WHEN 4 THEN ' ' WHEN 5 THEN concat(' \"F:\\box\\', source, '\" ') ELSE concat('local/', source) END"


@query(f"""WITH s AS (SELECT doc_id, trim(trim({SPOTS}), '"') AS p FROM documents), d AS (SELECT doc_id, p, CASE upper(regexp_extract(p, '^([A-Za-z]):', 1)) WHEN 'C' THEN 'local_fixed' WHEN 'D' THEN 'removable' WHEN 'E' THEN 'remote_mapped' WHEN '' THEN 'unknown' ELSE 'local_unverified' END AS by_drive,
    len(list_filter(string_split_regex(lower(p), '[\\\\/]+'), lambda x: regexp_matches(x, '^({'|'.join(boundary.CLOUD_MARKERS)})([ _-]|$)'))) > 0 AS cloud FROM s),
  t AS (SELECT doc_id, CASE WHEN p = '' THEN 'unknown' WHEN starts_with(p, '\\\\') OR starts_with(p, '//') THEN 'remote_unc' WHEN cloud THEN 'cloud_sync' ELSE by_drive END AS territory FROM d)
  SELECT doc_id, territory, territory IN ('remote_unc', 'cloud_sync', 'remote_mapped', 'removable') AS violation FROM t""".replace("'^([A-Za-z]):', 1", "'^([A-Za-z]):', 1"))
def boundary_violations(spark, sf_dir):
    """Territory of each place and whether it lies outside the fixed drives."""
    items = table(spark, sf_dir, "documents").selectExpr("doc_id", SPOTS.replace("\\", "\\\\") + " AS claimed_path")
    volumes = spark.createDataFrame([("C:", "fixed"), ("D:", "removable"), ("E:", "remote")], "drive string, type string")
    return boundary.territories(items, volumes).select("doc_id", "territory", "violation")


@query(f"SELECT territory, count(*) AS items, count(*) FILTER (WHERE violation) AS violations FROM ({ORACLE_SQL['boundary_violations']}) GROUP BY territory")
def boundary_territory(spark, sf_dir):
    items = table(spark, sf_dir, "documents").selectExpr(SPOTS.replace("\\", "\\\\") + " AS claimed_path")
    volumes = spark.createDataFrame([("C:", "fixed"), ("D:", "removable"), ("E:", "remote")], "drive string, type string")
    return boundary.counts(boundary.territories(items, volumes))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber * 2 - CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS n, l_linenumber AS ord, l_partkey FROM lineitem), o AS (SELECT *, lag(n) OVER (PARTITION BY l_orderkey ORDER BY ord, l_partkey, n) AS before FROM n),
  b AS (SELECT l_orderkey, count(*) AS rows, count(*) - count(DISTINCT n) AS repeated FROM o GROUP BY l_orderkey),
  g AS (SELECT l_orderkey, count(*) AS gaps, CAST(sum(next - n - 1) AS BIGINT) AS missing FROM (SELECT l_orderkey, n, lead(n) OVER (PARTITION BY l_orderkey ORDER BY n) AS next FROM (SELECT DISTINCT l_orderkey, n FROM n)) WHERE next > n + 1 GROUP BY l_orderkey)
  SELECT b.l_orderkey, rows, repeated, coalesce(gaps, 0) AS gaps, coalesce(missing, 0) AS missing FROM b LEFT JOIN g USING (l_orderkey)""")
def certificate_sequences(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 2 - F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(0)).cast("string").alias("seq"), F.col("l_linenumber").alias("ord"))
    return certificate.sequence_report(rows, "l_orderkey").select("l_orderkey", "rows", "repeated", "gaps", "missing")


CERTIFICATE = """SELECT doc_id AS ord, CASE WHEN doc_id % 50 = 7 THEN '' WHEN doc_id % 100 = 31 THEN concat('no. ', CAST(doc_id AS STRING)) WHEN doc_id % 40 = 3 THEN CAST(doc_id - 2 AS STRING) ELSE CAST(doc_id AS STRING) END AS seq, concat(CAST(doc_id AS STRING), CASE WHEN doc_id % 13 = 0 THEN '.doc' ELSE '.txt' END) AS name, CAST(n_chars AS STRING) AS size,
    concat('C:/docs/', source, '/', CAST(doc_id AS STRING), '.txt') AS path, MD5(text) AS md5, CASE WHEN doc_id % 10 = 0 THEN 'NOT-HEX' ELSE SHA1(text) END AS sha1, '' AS sha256,
    '' AS created, CASE WHEN doc_id % 8 = 0 THEN '2026-13-45' WHEN doc_id % 8 = 1 THEN '2026-02-01 12:00:00' ELSE '2025-12-30 08:15:00' END AS modified, '' AS accessed FROM documents"""


def certificate_rows(spark, sf_dir):
    return spark.sql(CERTIFICATE.replace("SHA1(text)", "sha1(text)").replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


@query("WITH p AS (SELECT 'md5' AS field, md5(text) AS value, doc_id FROM documents UNION ALL SELECT 'sha1', CASE WHEN doc_id % 10 = 0 THEN 'not-hex' ELSE sha1(text) END, doc_id FROM documents UNION ALL SELECT 'path', lower(concat('C:/docs/', source, '/', CAST(doc_id AS STRING), '.txt')), doc_id FROM documents) SELECT field, value, count(*) AS count, min(doc_id) AS first_row FROM p GROUP BY field, value HAVING count(*) > 1")
def certificate_duplicates(spark, sf_dir):
    return certificate.duplicates(certificate_rows(spark, sf_dir))


@query(f"WITH c AS ({CERTIFICATE}), d AS (SELECT ord, 'sha1' AS field, sha1 AS value, 40 AS n FROM c UNION ALL SELECT ord, 'md5', md5, 32 FROM c UNION ALL SELECT ord, 'sha256', sha256, 64 FROM c) SELECT ord, field, value FROM d WHERE value <> '' AND (length(value) <> n OR NOT regexp_full_match(value, '[0-9a-fA-F]+'))")
def certificate_digests(spark, sf_dir):
    return certificate.bad_digests(certificate_rows(spark, sf_dir))


@query(f"WITH c AS ({CERTIFICATE}) SELECT ord, name, string_split(path, '/')[-1] AS base FROM c WHERE name <> string_split(path, '/')[-1]")
def certificate_names(spark, sf_dir):
    return certificate.name_mismatches(certificate_rows(spark, sf_dir))


@query(f"WITH c AS ({CERTIFICATE}) SELECT ord FROM c WHERE TRY_CAST(modified AS TIMESTAMP) > TIMESTAMP '2026-01-01 12:00:00'")
def certificate_after_issue(spark, sf_dir):
    return certificate.after_issue(certificate_rows(spark, sf_dir), certificate.issued_at(F.lit("list_20260101120000.xlsx"))).select("ord")


@query("""SELECT * FROM (SELECT 'hash_format' AS "check", 'fail' AS severity, count(*) AS count FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'name_path_mismatch', 'warn', count(*) FROM documents WHERE doc_id % 13 = 0
  UNION ALL SELECT 'post_cert_mtime', 'fail', count(*) FROM documents WHERE doc_id % 8 = 1 UNION ALL SELECT 'unparseable_date', 'info', count(*) FROM documents WHERE doc_id % 8 = 0
  UNION ALL SELECT 'duplicate_md5', 'warn', count(*) FROM (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate_sha1', 'warn', count(*) FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'not-hex' ELSE sha1(text) END FROM documents GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate_path', 'warn', count(*) FROM (SELECT lower(concat(source, CAST(doc_id AS STRING))) FROM documents GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'seq_integrity', 'warn', odd + CASE WHEN odd > 0 THEN 1 ELSE 0 END + CASE WHEN many > kinds THEN 1 ELSE 0 END + CASE WHEN high - low + 1 > kinds THEN 1 ELSE 0 END + CASE WHEN downs > 0 THEN 1 ELSE 0 END
    FROM (SELECT count(*) FILTER (WHERE seq <> '' AND n IS NULL) AS odd, count(n) AS many, count(DISTINCT n) AS kinds, min(n) AS low, max(n) AS high, count(*) FILTER (WHERE n < before) AS downs
      FROM (SELECT seq, n, lag(n IGNORE NULLS) OVER (ORDER BY ord) AS before FROM (SELECT ord, seq, CASE WHEN regexp_full_match(seq, '[0-9]+') THEN CAST(seq AS BIGINT) END AS n FROM (""" + CERTIFICATE + """))))) WHERE count > 0""")
def certificate_findings(spark, sf_dir):
    return certificate.findings(certificate_rows(spark, sf_dir), certificate.issued_at(F.lit("list_20260101120000.xlsx"))).select("check", "severity", "count")


@query(f"""WITH c AS ({CERTIFICATE}), f AS (SELECT 'hash_format' AS "check", ord FROM ({ORACLE_SQL['certificate_digests']}) UNION ALL SELECT 'name_path_mismatch', ord FROM ({ORACLE_SQL['certificate_names']}) UNION ALL SELECT 'post_cert_mtime', ord FROM ({ORACLE_SQL['certificate_after_issue']})
    UNION ALL SELECT 'unparseable_date', ord FROM c WHERE modified <> '' AND TRY_CAST(modified AS TIMESTAMP) IS NULL UNION ALL SELECT concat('duplicate_', field), first_row FROM ({ORACLE_SQL['certificate_duplicates']}))
  SELECT "check", array_to_string(list_slice(list(ord ORDER BY ord), 1, 10), ',') AS samples FROM f GROUP BY "check" """)
def certificate_samples(spark, sf_dir):
    """The first ten places of each check but that of the numbering."""
    found = certificate.findings(certificate_rows(spark, sf_dir), certificate.issued_at(F.lit("list_20260101120000.xlsx")))
    return found.where("check <> 'seq_integrity'").select("check", F.array_join("samples", ",").alias("samples"))


#: Files on the returned disk: most as listed, some of another size or content, some gone; names as in CERTIFICATE.
RETURNED = """SELECT concat('docs/', source, '/', CAST(doc_id AS STRING), '.txt') AS path, n_chars + CASE WHEN doc_id % 14 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN doc_id % 15 = 0 THEN NULL ELSE MD5(text) END AS md5, CASE WHEN doc_id % 16 = 0 THEN SHA1(concat(text, 'x')) ELSE SHA1(text) END AS sha1, CAST(NULL AS STRING) AS sha256 FROM documents WHERE doc_id % 12 <> 5"""


def returned(spark, sf_dir):
    return spark.sql(RETURNED.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


_LIVE = f"""WITH c AS ({CERTIFICATE}), r AS ({RETURNED}), j AS (SELECT c.ord, replace(c.path, 'C:/', '') AS path, r.path IS NOT NULL AS here, CAST(c.size AS BIGINT) AS claimed, r.size, lower(c.sha1) AS csha1, r.sha1, c.md5 AS cmd5, r.md5 FROM c LEFT JOIN r ON r.path = replace(c.path, 'C:/', '')) """


@query(_LIVE + """SELECT ord, path, CASE WHEN NOT here THEN 'missing' WHEN claimed <> size THEN 'size_mismatch' WHEN csha1 <> sha1 OR cmd5 <> md5 THEN 'hash_mismatch' ELSE 'match' END AS result FROM j""")
def certificate_reverify(spark, sf_dir):
    return certificate.reverify(certificate_rows(spark, sf_dir), returned(spark, sf_dir))


@query(_LIVE + "SELECT count(*) FILTER (WHERE here) AS resolved, count(*) FILTER (WHERE NOT here) AS missing, count(*) FILTER (WHERE here AND claimed = size) AS size_match, count(*) FILTER (WHERE here AND claimed <> size) AS size_mismatch, count(*) FILTER (WHERE here AND csha1 = sha1) AS hash_verified, count(*) FILTER (WHERE here AND csha1 <> sha1) AS hash_mismatch, count(*) FILTER (WHERE here AND sha1 IS NULL) AS hash_skipped FROM j")
def certificate_live(spark, sf_dir):
    return certificate.live_stats(certificate_rows(spark, sf_dir), returned(spark, sf_dir))


EVENT_MASK = "CASE event_type WHEN 'click' THEN 256 WHEN 'view' THEN 512 WHEN 'purchase' THEN 2147483648 + 2 WHEN 'scroll' THEN 4096 ELSE 2048 END + CASE WHEN user_id % 5 = 0 THEN 32768 ELSE 0 END"


def journal_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return journal.decode(events.select("event_id", F.expr(f"concat('f', user_id % 100, '.tmp')").alias("file_name"), F.expr(EVENT_MASK).cast("long").alias("reason_mask"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp_utc")))


_NAMES = "concat_ws('|', " + ", ".join(f"CASE WHEN m & {bit} <> 0 THEN '{name}' END" for bit, name in reasons.REASONS.items()) + ")"
MASKS = f"WITH e AS (SELECT event_id, user_id, ts, CAST({EVENT_MASK} AS BIGINT) AS m FROM events)"


@query(MASKS + f" SELECT event_id, {_NAMES} AS reasons FROM e")
def journal_decode(spark, sf_dir):
    return journal_events(spark, sf_dir).select("event_id", F.array_join("reasons", "|").alias("reasons"))


@query(MASKS + f" SELECT reason, count(*) AS events FROM (SELECT unnest(string_split({_NAMES}, '|')) AS reason FROM e) GROUP BY reason")
def journal_histogram(spark, sf_dir):
    return journal.histogram(journal_events(spark, sf_dir))


@query(MASKS + " SELECT event_id FROM e WHERE m & (512 | 4096 | 2048) <> 0")
def journal_notable(spark, sf_dir):
    return journal.notable(journal_events(spark, sf_dir)).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND concat('f', user_id % 100, '.tmp') LIKE '%7.tmp%'")
def journal_select(spark, sf_dir):
    return journal.select(journal_events(spark, sf_dir), "2024-01-10T00:00:00+00:00", "7.TMP").select("event_id")


@query("WITH t AS (SELECT concat('log', user_id % 50) AS path, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS t FROM events) SELECT path, 'ok' AS status, count(*) AS event_count, arg_min(t, event_id) AS first_event_utc, arg_max(t, event_id) AS last_event_utc FROM t GROUP BY path UNION ALL SELECT 'empty', 'no_records', 0, NULL, NULL")
def event_timelines(spark, sf_dir):
    """First and last record of each log by its place in the file, and one log without records."""
    records = table(spark, sf_dir, "events").select(F.concat(F.lit("log"), F.col("user_id") % 50).alias("path"), F.col("event_id").alias("at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp_utc"))
    logs = records.select("path").distinct().union(spark.createDataFrame([("empty",)], "path string"))
    return artifacts.timelines(logs, records)


#: Records of started programs as a hive keeps them: count at byte 4 and time at 60, least byte first; short ones have the time at 8.
_LE = "concat(substr(h, 15, 2), substr(h, 13, 2), substr(h, 11, 2), substr(h, 9, 2), substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2))"


@query("SELECT concat('NTUSER', CAST(user_id % 7 AS STRING)) AS path, concat('C:/Bin/', event_type, CAST(event_id AS STRING), '.exe') AS program, CASE WHEN event_id % 11 > 0 THEN user_id END AS run_count, CASE WHEN event_id % 11 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS last_run_utc FROM events")
def hive_userassist(spark, sf_dir):
    ticks = F.unix_micros(F.col("ts").cast("timestamp")) * 10 + timeutil.FILETIME_EPOCH
    e = table(spark, sf_dir, "events").withColumn("h", F.lpad(F.hex(ticks), 16, "0")).withColumn("time", F.expr(_LE)).withColumn("h", F.lpad(F.hex(F.col("user_id").cast("long")), 16, "0"))
    count = F.substring(F.expr(_LE), 1, 8)
    zeros = lambda n: F.repeat(F.lit("00"), F.lit(n))
    data = F.when(F.col("event_id") % 11 == 0, zeros(12)).when(F.col("event_id") % 3 == 0, F.concat(zeros(4), count, F.col("time"))).otherwise(F.concat(zeros(4), count, zeros(52), F.col("time"), zeros(4)))
    name = parsers.rot13(F.concat(F.lit("C:/Bin/"), "event_type", "event_id", F.lit(".exe")))
    rows = e.select(F.concat(F.lit("NTUSER"), F.col("user_id") % 7).alias("path"), F.lit("ntuser.dat").alias("hive"), F.lit("software/microsoft/windows/currentversion/explorer/userassist/{x}/count").alias("rel"), name.alias("value_name"), F.unhex(data).alias("data"))
    return artifacts.userassist(rows)


@query(f"SELECT event_id, CAST({EVENT_MASK} AS BIGINT) AS mask FROM events")
def journal_reason_text(spark, sf_dir):
    return journal_events(spark, sf_dir).select("event_id", reasons.mask(F.array_join("reasons", " | ")).alias("mask"))


ORDER_FILES = """SELECT o_orderkey, CAST(o_orderkey AS STRING) AS path, CASE WHEN o_orderstatus = 'P' THEN 'symlink' ELSE 'file' END AS kind,
  us * 1000 AS mtime_ns, us * 1000 - 86400000000000 * 30 AS ctime_ns, us * 1000 + 86400000000000 * 60 AS atime_ns FROM (SELECT *, EPOCH AS us FROM orders)"""
LOW, HIGH = 820454400000000000, 852076800000000000


def order_files(spark, sf_dir):
    return spark.sql(ORDER_FILES.replace("EPOCH", "unix_micros(CAST(o_orderdate AS TIMESTAMP))").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


@query(f"""WITH f AS ({ORDER_FILES.replace("EPOCH", "epoch_us(o_orderdate)")}), w AS (SELECT o_orderkey, ctime_ns BETWEEN {LOW} AND {HIGH} AS created, mtime_ns BETWEEN {LOW} AND {HIGH} AS modified, atime_ns BETWEEN {LOW} AND {HIGH} AND NOT mtime_ns BETWEEN {LOW} AND {HIGH} AS accessed_only,
  ctime_ns, mtime_ns FROM f WHERE kind <> 'symlink') SELECT o_orderkey, created, modified, accessed_only, strftime(make_timestamp((CASE WHEN created THEN ctime_ns ELSE mtime_ns END) // 1000), '%Y-%m-%dT%H:%M:%S+00:00') AS first_seen FROM w WHERE created OR modified OR accessed_only""")
def raid_window(spark, sf_dir):
    return journal.window(order_files(spark, sf_dir), LOW, HIGH).select("o_orderkey", "created", "modified", "accessed_only", "first_seen")


@query("WITH w AS (" + ORACLE_SQL["raid_window"] + "), f AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'P') SELECT count(*) AS files, count(*) FILTER (WHERE created) AS created, count(*) FILTER (WHERE modified) AS modified, count(*) FILTER (WHERE accessed_only) AS accessed_only, count(*) > 1000 AS truncated, (SELECT n FROM f) AS entries_scanned, 0 AS read_errors FROM w")
def window_summary(spark, sf_dir):
    files = order_files(spark, sf_dir).withColumn("status", F.lit("ok"))
    return journal.window_summary(journal.window(files, LOW, HIGH), files, most=1000)


#: Paths made of pages' addresses and documents' columns, in places that mean something and others.
TRACES = "concat(CASE doc_id % 9 WHEN 0 THEN 'Windows/Prefetch/' WHEN 1 THEN 'Windows/System32/winevt/Logs/' WHEN 2 THEN 'Users/a/AppData/Roaming/Microsoft/Windows/Recent/' WHEN 3 THEN 'Windows/System32/config/' WHEN 4 THEN 'Windows/System32/drivers/' WHEN 5 THEN 'Users/b/AppData/Roaming/Apple Computer/MobileSync/Backup/' WHEN 6 THEN 'Users/b/Documents/smart_Switch1/' WHEN 7 THEN 'Users/c/AppData/Local/Kakao/KakaoTalk/' ELSE 'docs/' END, CASE doc_id % 4 WHEN 0 THEN 'Security.evtx' WHEN 1 THEN 'SYSTEM' WHEN 2 THEN concat(source, '.lnk') ELSE concat(lang, '-0A1B2C3D.pf') END)"


@query(f"""WITH t AS (SELECT doc_id, {TRACES} AS p FROM documents), l AS (SELECT *, lower(p) AS low, lower(regexp_extract(p, '[^/]*$')) AS base FROM t)
  SELECT doc_id, CASE WHEN list_contains(string_split(low, '/'), 'prefetch') THEN 'prefetch' WHEN list_contains(string_split(low, '/'), 'winevt') AND (contains(base, 'system.evtx') OR contains(base, 'security.evtx') OR contains(base, 'printservice') OR contains(base, 'operational.evtx') OR contains(base, 'kernel-pnp') OR contains(base, 'partition')) THEN 'evtx'
    WHEN contains(low, 'microsoft/windows/recent') THEN 'recent_items' WHEN base IN ('system', 'software', 'sam', 'security', 'ntuser.dat', 'usrclass.dat', 'amcache.hve', 'setupapi.dev.log') THEN 'registry_or_device_log' WHEN starts_with(low, 'windows/system32/drivers/') THEN 'drivers' END AS category,
    CASE WHEN regexp_matches(p, '^Users/.*/AppData/Local/Kakao/KakaoTalk/') THEN 'kakaotalk_pc' WHEN regexp_matches(p, '^Users/.*/MobileSync/Backup/') THEN 'itunes_backup' WHEN regexp_matches(p, '^Users/.*/Documents/.*[Ss]mart[ _-][Ss]witch.*/') THEN 'smartswitch' END AS target,
    CASE WHEN regexp_matches(regexp_extract(p, '[^/]*$'), '(?i)^.+-[0-9a-f]{{8,16}}[.]pf$') THEN regexp_extract(regexp_extract(p, '[^/]*$'), '(?i)^(.+)-[0-9a-f]{{8,16}}[.]pf$', 1) ELSE regexp_replace(regexp_extract(p, '[^/]*$'), '[.][^.]*$', '') END AS exe FROM l""")
def artifact_places(spark, sf_dir):
    """What kind of artifact each path is, whether it belongs to a phone's data, and the program that its name gives."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(TRACES).alias("p"))
    p = F.col("p")
    return rows.select("doc_id", evidence.artifact_category(p).alias("category"), evidence.mobile_target(p).alias("target"), artifacts.exe_guess(paths.basename(p)).alias("exe"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('day', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) WHEN 2 THEN epoch_us(date_trunc('second', ts)) - 9 * 3600000000 END * 1000 AS ns, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS loose FROM events")
def written_times(spark, sf_dir):
    """Times read from ISO texts (a date, Z, an offset, no time) and from loosely written Korean ones."""
    t = F.col("ts").cast("timestamp")
    iso = F.when(F.col("event_id") % 4 == 0, F.date_format(t, "yyyy-MM-dd")).when(F.col("event_id") % 4 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+09:00'")).otherwise(F.lit("soon"))
    hour = F.hour(t)
    loose = F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format(t, "yyyy년 M월 d일 "), F.when(hour < 12, F.lit("오전 ")).otherwise(F.lit("오후 ")), F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12), F.lit("시 "), F.minute(t), F.lit("분"))).otherwise(F.date_format(t, "yyyy.M.d. H:mm"))
    return table(spark, sf_dir, "events").select("event_id", timeutil.iso_to_ns(iso).alias("ns"), F.date_format(timeutil.lenient_datetime(loose), "yyyy-MM-dd HH:mm:ss").alias("loose"))


NAMES = "concat(CASE doc_id % 8 WHEN 0 THEN 'selected_files' WHEN 1 THEN 'deselectedTab' WHEN 2 THEN '압수물목록' WHEN 3 THEN 'gpresult' WHEN 4 THEN 'forensic-report' ELSE lang END, CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.zip' WHEN 3 THEN '.gif' ELSE '.exe' END)"
_HINT = "(regexp_matches(name, '(^|[^a-z0-9])(list|seiz|evid|forens|output|report|result|export|extract|select|item)') OR regexp_matches(name, '목록|리스트|압수|전자정보|압수물|선별|영장|조서|수사|증거'))"


@query(f"""WITH n AS (SELECT doc_id, lower({NAMES}) AS name FROM documents), c AS (SELECT doc_id, CASE WHEN name LIKE '%.zip' THEN CASE WHEN {_HINT} THEN 'container_named' ELSE 'container_in_window' END
  WHEN (name LIKE '%.txt' OR name LIKE '%.xlsx') AND {_HINT} THEN 'list_named' WHEN {_HINT} THEN 'name_match' WHEN name LIKE '%.txt' OR name LIKE '%.xlsx' THEN 'possible_list' END AS category FROM n)
  SELECT doc_id, category FROM c WHERE category IS NOT NULL""")
def leftovers_signature(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("doc_id", F.expr(NAMES).alias("path"))
    return names.select("doc_id", evidence.leftover_category(F.col("path")).alias("category")).where("category IS NOT NULL")


@query(ORACLE_SQL["leftovers_signature"].rpartition("SELECT doc_id, category FROM c")[0] + f""", b AS (SELECT CASE WHEN name LIKE '%.txt' OR name LIKE '%.xlsx' OR name LIKE '%.zip' OR {_HINT} THEN 'bin_list_or_container' ELSE 'bin_deleted' END AS category FROM n WHERE doc_id % 3 > 0)
  SELECT channel, category, count(*) AS items, count(*) > 100 AS truncated FROM (SELECT 'file' AS channel, category FROM c WHERE category IS NOT NULL UNION ALL SELECT 'recycle_bin', category FROM b) GROUP BY channel, category""")
def leftover_channels(spark, sf_dir):
    """Files of the window and what recycle bins hold of it, by channel and category."""
    names = table(spark, sf_dir, "documents").select("doc_id", F.expr(NAMES).alias("path"), F.lit("file").alias("kind"), F.lit(T0).alias("mtime_ns"), F.col("n_chars").alias("size"))
    record = F.struct(F.concat(F.lit("C:\\x\\"), "path").alias("original_path"), (F.col("doc_id") % 3).alias("deleted"), "size")
    info = names.select(F.concat(F.lit("$Recycle.Bin/S/$I"), "doc_id").alias("path"), record.alias("r"))
    held = names.where("doc_id % 2 = 0").select(F.concat(F.lit("$Recycle.Bin/S/$R"), "doc_id").alias("path"), "size")
    return evidence.leftover_summary(evidence.leftovers(names, T0, None, None, evidence.recycle_bin(info, held, 1, 2)), 100)


@query(f"WITH base AS ({BASE}) SELECT status, count(*) AS count FROM base GROUP BY status")
def inventory_statuses(spark, sf_dir):
    return inventory.counts(base(spark, sf_dir), "status")


#: Journal names made from an event's own columns, half of them telling ones.
GONE_NAME = "concat(CASE user_id % 4 WHEN 0 THEN 'selected_' WHEN 1 THEN 'deselected' WHEN 2 THEN '목록_' ELSE 'x' END, event_type, CASE event_id % 5 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.tmp' WHEN 2 THEN '.zip' WHEN 3 THEN '.dat' ELSE '' END)"


@query(MASKS + f""", g AS (SELECT event_id, m, lower({GONE_NAME}) AS name FROM e JOIN events USING (event_id, user_id, ts)) SELECT name, count(*) AS events FROM g
  WHERE m & (512 | 4096) <> 0 AND (name LIKE '%.xlsx' OR name LIKE '%.zip' OR {_HINT}) GROUP BY name""")
def leftovers_deleted(spark, sf_dir):
    """Deleted or renamed-away names that look like lists or containers, or hint at one; no time window."""
    events = journal_events(spark, sf_dir).select("event_id", "reasons", "timestamp_utc").join(table(spark, sf_dir, "events").select("event_id", F.expr(GONE_NAME).alias("file_name")), "event_id")
    none = base(spark, sf_dir).where("false")
    found = evidence.leftovers(none, None, None, journal.deletions(events))
    return found.where("channel = 'journal' AND category = 'deleted_in_window'").groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("events"))


#: Names with each tool's marker in turn, some with two; and names of none.
_MARKS = "|".join([*evidence.TOOL_MARKERS, "", "", ""])
STEMS = f"concat('My', split_part('{_MARKS}', '|', CAST(doc_id % {len(evidence.TOOL_MARKERS) + 3} AS INT) + 1), CASE WHEN doc_id % 7 = 3 THEN '-KAPE' ELSE '' END, '_', source)"
_LABELS = "CASE " + " ".join(f"WHEN contains(lower(stem), '{m}') THEN '{label}'" for m, label in evidence.TOOL_MARKERS.items()) + " END"


@query(f"WITH s AS (SELECT {STEMS} AS stem FROM documents), l AS (SELECT stem, {_LABELS} AS label FROM s) SELECT label, count(*) AS items, min(concat(stem, '.exe')) AS first_path FROM l WHERE label IS NOT NULL GROUP BY label")
def tool_labels(spark, sf_dir):
    return evidence.observed_tools(table(spark, sf_dir, "documents").select(F.concat(F.expr(STEMS), F.lit(".exe")).alias("path")))


#: Places of print spools, bins and temporary files, and look-alikes of them.
PLACES = "concat(CASE doc_id % 8 WHEN 0 THEN 'Windows/System32/spool/PRINTERS/' WHEN 1 THEN '$Recycle.Bin/S-1/' WHEN 2 THEN 'Users/Temp/' WHEN 3 THEN 'Users/x/AppData/Local/Temp/' WHEN 4 THEN 'RECYCLER/' WHEN 5 THEN 'docs/printers/' WHEN 6 THEN 'docs/recycler2/' ELSE 'Temporary/' END, CASE doc_id % 5 WHEN 0 THEN 'evidence' WHEN 1 THEN 'cache' WHEN 2 THEN '압수' WHEN 3 THEN 'seized-' ELSE source END, CASE doc_id % 3 WHEN 0 THEN '.bin' WHEN 1 THEN '.CSV' ELSE '' END)"
_REPORTS, _TELLING = "|".join(e[1:] for e in evidence.REPORT_EXTENSIONS), "|".join(evidence.SOURCE_HINTS)


@query(f"""WITH p AS (SELECT doc_id, lower({PLACES}) AS p FROM documents), n AS (SELECT doc_id, string_split(p, '/') AS parts, string_split(p, '/')[-1] AS name FROM p)
  SELECT doc_id, CASE WHEN list_contains(parts, 'spool') AND list_contains(parts, 'printers') THEN 'spool' WHEN parts[1] LIKE '$recycle.bin%' OR list_contains(parts, 'recycler') THEN 'recycle_bin'
    WHEN list_contains(parts, 'temp') AND doc_id >= 50 AND (regexp_matches(name, '[.]({_REPORTS})$') OR regexp_matches(name, '{_TELLING}')) THEN 'temp' END AS reason FROM n""")
def source_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(PLACES).alias("p"))
    return rows.select("doc_id", evidence.source_reason(F.col("p"), F.col("doc_id"), since_ns=50).alias("reason"))


@query("""WITH s AS (SELECT source, sha256(string_agg(sha256(text), '' ORDER BY lang, CAST(doc_id AS STRING))) AS root, count(*) AS files FROM documents GROUP BY source) SELECT source, files, root FROM s""")
def root_hash_seal(spark, sf_dir):
    sums = table(spark, sf_dir, "documents").select("source", F.concat("lang", F.lit("/"), "doc_id").alias("rel"), F.sha2("text", 256).alias("digest"))
    return custody.root_hash(sums, "source")


CHECKED = f"WITH base AS ({BASE}), cur AS ({CURRENT}), v AS (SELECT b.path AS name, CASE WHEN a.path IS NULL THEN 'missing' WHEN b.sha256 IS NULL OR a.sha256 IS NULL THEN 'unverifiable' WHEN a.sha256 = b.sha256 THEN 'ok' ELSE 'mismatch' END AS verdict FROM base b LEFT JOIN cur a ON a.path = b.path) "


@query(CHECKED + "SELECT name, verdict FROM v")
def checksum_verify(spark, sf_dir):
    return custody.check_sums(base(spark, sf_dir).select(F.col("path").alias("name"), F.col("sha256").alias("digest")), current(spark, sf_dir).select(F.col("path").alias("name"), F.col("sha256").alias("digest")))


@query(f"WITH base AS ({BASE}), claims AS ({CLAIMS}) SELECT c.rel, c.ord, CASE WHEN b.path IS NULL THEN 'missing' WHEN digest IS NULL THEN 'no_claimed_hash' WHEN length(digest) <> 64 OR b.sha256 IS NULL THEN 'incomparable' WHEN digest = b.sha256 THEN 'match' ELSE 'mismatch' END AS hash_vs_claimed FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY ord) AS k FROM claims) c LEFT JOIN base b ON b.path = c.rel WHERE k = 1")
def mirror_plan(spark, sf_dir):
    return custody.mirror_plan(claims(spark, sf_dir), base(spark, sf_dir)).drop("size")


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 3 > 0 THEN 0 ELSE 1 END, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, doc_id DESC) AS k FROM documents) WHERE k = 1""")
def source_priority(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("doc_id") % 3).alias("parsed"), F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2).alias("priority"))
    return evidence.pick_source(c, ["source"], "priority", "doc_id").select("source", "doc_id")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM pages")
def html_text_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), "[ \\t\\n\\r]+", " ")).alias("text"))


PRINTED = "concat('x ', CASE WHEN doc_id % 3 > 0 THEN SHA1(text) ELSE 'none' END, ' ', SHA256(text), ', ', substr(SHA1(source), 1, 39 + doc_id % 2), '.')"


@query(f"SELECT doc_id, len(list_filter(regexp_split_to_array({PRINTED}, '[^0-9a-fA-F]+'), lambda x: length(x) = 40)) AS printed FROM documents")
def printed_digests(spark, sf_dir):
    text = F.expr(PRINTED.replace("SHA1(", "sha1(").replace("SHA256(text)", "sha2(text, 256)"))
    return table(spark, sf_dir, "documents").select("doc_id", certificate.printed_digests(text).alias("printed"))


ASKED = ["src8/", ".bin", "moved/", "absent"]


@query(VERIFIED.replace("WITH base", "WITH base", 1) + f""", cur AS ({CURRENT}), q AS (SELECT unnest({ASKED!r}) AS query), h AS (SELECT q.query, 'item' AS source, coalesce(v.matched_path, v.claimed_path) AS path FROM q JOIN verified v ON contains(lower(concat_ws(chr(10), v.claimed_path, v.matched_path)), q.query)),
  p AS (SELECT DISTINCT path FROM (SELECT path FROM cur WHERE path LIKE 'moved/%' UNION ALL SELECT path FROM base)) SELECT * FROM h UNION ALL SELECT q.query, 'change', p.path FROM q JOIN p ON contains(lower(p.path), q.query) WHERE q.query NOT IN (SELECT query FROM h) AND p.path LIKE 'moved/%'""")
def inquiry(spark, sf_dir):
    return custody.inquire(results(spark, sf_dir), changes(spark, sf_dir), spark.createDataFrame([(a,) for a in ASKED], "query string"))


@query("SELECT event_id, epoch_us(ts) * 10 + 116444736000000000 AS ticks, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events")
def filetime_roundtrip(spark, sf_dir):
    ticks = F.unix_micros(F.col("ts").cast("timestamp")) * 10 + timeutil.FILETIME_EPOCH
    return table(spark, sf_dir, "events").select("event_id", ticks.alias("ticks")).select("event_id", "ticks", timeutil.filetime_to_iso(F.col("ticks")).alias("iso"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha1' WHEN 2 THEN 'sha256' END AS algorithm, CASE doc_id % 4 WHEN 0 THEN md5(text) WHEN 1 THEN sha1(text) WHEN 2 THEN sha256(text) END AS digest FROM documents")
def digest_by_name(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", digests.digest(F.col("text").cast("binary"), F.expr("CASE doc_id % 4 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha1' WHEN 2 THEN 'sha256' END")).alias("digest"))
    return d.select("doc_id", digests.algorithm(F.col("digest")).alias("algorithm"), "digest")


PASSES = "SELECT CAST(floor(date_part('day', ts) / 5) AS BIGINT) AS pass, concat('u', CAST(user_id AS STRING)) AS path, count(*) AS size, max(CAST(event_id AS BIGINT)) AS mtime_ns, 'file' AS kind FROM events GROUP BY 1, 2"


def passes(spark, sf_dir):
    return spark.sql(PASSES.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


@query(f"""WITH s AS ({PASSES}), p AS (SELECT DISTINCT pass FROM s), o AS (SELECT pass, lag(pass) OVER (ORDER BY pass) AS before FROM p), k AS (SELECT DISTINCT path FROM s)
  SELECT pass, event, path FROM (SELECT o.pass, k.path, CASE WHEN b.path IS NULL AND a.path IS NOT NULL THEN 'created' WHEN b.path IS NOT NULL AND a.path IS NULL THEN 'removed' WHEN a.size <> b.size OR a.mtime_ns <> b.mtime_ns THEN 'modified' END AS event
    FROM o CROSS JOIN k LEFT JOIN s a ON a.pass = o.pass AND a.path = k.path LEFT JOIN s b ON b.pass = o.before AND b.path = k.path WHERE o.before IS NOT NULL) WHERE event IS NOT NULL""")
def watch_passes(spark, sf_dir):
    return watch.all_passes(passes(spark, sf_dir))


@query(ORACLE_SQL["watch_passes"])
def stream_watch(spark, sf_dir):
    """The same passes, one micro-batch each, through the streaming monitor; its events are those of watch_passes."""
    import uuid

    root = f"{shared_folder(spark)}/watch-{uuid.uuid4()}"
    rows = passes(spark, sf_dir)
    for (number,) in sorted(rows.select("pass").distinct().collect()):  # a few
        rows.where(F.col("pass") == number).write.mode("append").parquet(f"{root}/in")
        watch.start(spark.readStream.schema(watch.SNAPSHOT).parquet(f"{root}/in"), f"{root}/events", f"{root}/checkpoint", buckets=64).awaitTermination()
    return watch.monitored(spark, f"{root}/events").where("event <> 'snapshot_init'").select("pass", "event", "path")


#: Documents as parts of archives of a source's next 1,000 ids; of some archives the second part is lost, of some the digest that they had isn't known or another.
PARTS = """SELECT concat(source, '-', CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS STRING), '.zip') AS archive, row_number() OVER (PARTITION BY source, floor(doc_id / 1000) ORDER BY doc_id) AS part, text, doc_id FROM documents"""


@query(f"""WITH p AS ({PARTS}), w AS (SELECT archive, sha256(string_agg(text, '' ORDER BY part)) AS whole FROM p GROUP BY archive), kept AS (SELECT * FROM p WHERE NOT (archive LIKE 'src3-%' AND part = 2)),
  h AS (SELECT archive, count(*) AS parts, sum(strlen(text))::BIGINT AS bytes, sha256(string_agg(text, '' ORDER BY part)) AS sha256, (max(part) - count(*))::BIGINT AS missing FROM kept GROUP BY archive)
  SELECT h.archive, parts, bytes, sha256, missing, CASE WHEN missing > 0 THEN 'missing_part' WHEN h.archive LIKE 'src5-%' THEN 'unverifiable' WHEN h.archive LIKE 'src7-%' THEN 'mismatch' WHEN sha256 = whole THEN 'ok' ELSE 'mismatch' END AS verdict FROM h JOIN w ON w.archive = h.archive""")
def rejoin_check(spark, sf_dir):
    """Archives joined from their parts, against the digests that they had before they were split."""
    parts = view(spark, sf_dir, PARTS).withColumnRenamed("text", "content")
    before = custody.rejoined(parts, parts.select("archive", F.lit(None).cast("string").alias("digest")).limit(0))
    known = F.when(F.startswith("archive", F.lit("src7-")), F.sha2("sha256", 256)).when(~F.startswith("archive", F.lit("src5-")), F.col("sha256"))
    return custody.rejoined(parts.where("NOT (archive LIKE 'src3-%' AND part = 2)"), before.select("archive", known.alias("digest")))


#: Orders as manifests, a user's events as a watcher's log.
MANIFESTS = '''SELECT concat('case/run-', CAST(o_orderkey AS STRING), '/manifest.json') AS path, concat('{"command":"', lower(o_orderpriority), '","finished_utc":"', CAST(o_orderdate AS STRING), '"}') AS content FROM orders'''
LOGS = '''SELECT concat('watch/', CAST(user_id AS STRING)) AS path, event_id AS ord, concat(CASE WHEN event_id % 13 = 0 THEN 'torn ' ELSE '' END, '{"event":"', event_type, '"', CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(',"ts":"', CAST(ts AS STRING), '"') END, '}') AS value FROM events'''


@query(f"""WITH m AS ({MANIFESTS}), l AS (SELECT *, json_extract_string(value, '$.event') AS event, json_extract_string(value, '$.ts') AS ts FROM ({LOGS}) WHERE value LIKE '{{%'),
  k AS (SELECT path, string_agg(event || '=' || n, ', ' ORDER BY event) AS kinds FROM (SELECT path, event, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY path),
  w AS (SELECT path, arg_min(ts, ord) FILTER (WHERE ts IS NOT NULL) AS first, arg_max(ts, ord) FILTER (WHERE ts IS NOT NULL) AS last FROM l GROUP BY path),
  e AS (SELECT json_extract_string(content, '$.finished_utc') AS ts, json_extract_string(content, '$.command') || ' finished (' || split_part(path, '/', 2) || '/, manifest ' || left(sha256(content), 16) || ')' AS description FROM m
    UNION ALL SELECT coalesce(first, '?'), 'watched from ' || coalesce(first, '?') || ' to ' || coalesce(last, '?') || ': ' || kinds FROM w JOIN k ON k.path = w.path)
  SELECT row_number() OVER (ORDER BY ts, description) AS no, ts, description FROM e""")
def procedure_log(spark, sf_dir):
    """Steps and watches of a case in one numbered order."""
    own = lambda sql, name: spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, sf_dir, name)})
    manifests, lines = own(MANIFESTS, "orders"), own(LOGS, "events")
    return procedure.log(procedure.steps(manifests), procedure.watches(lines))


@query()
def text_strings(spark, sf_dir):
    """Readable runs of each page's bytes."""
    return table(spark, sf_dir, "pages").select("page_id", parsers.strings(F.col("html").cast("binary"), F.lit(2000)).alias("strings"))


@query("SELECT page_id, sha256(html) AS digest, length(html) AS chars FROM pages")
def text_extraction(spark, sf_dir):
    """Text of each page's bytes as a .html file: decoding gives every character back."""
    got = table(spark, sf_dir, "pages").select("page_id", parsers.extract_text(F.col("html").cast("binary"), F.lit(".html")).alias("t"))
    return got.select("page_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("long").alias("chars"))


@query("SELECT doc_id AS ord, concat('C:/d/', CAST(doc_id AS STRING), '.txt') AS claimed_path, concat('d/', CAST(doc_id AS STRING), '.txt') AS rel, CASE WHEN doc_id % 3 = 0 THEN md5(text) END AS digest FROM documents")
def claims_from_text(spark, sf_dir):
    """Lines of a text list: a digest and a path, columns with '|', or a path."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.expr("CASE doc_id % 3 WHEN 0 THEN concat(upper(md5(text)), '  C:/d/', doc_id, '.txt') WHEN 1 THEN concat('12 | x | C:/d/', doc_id, '.txt') ELSE concat('  C:/d/', doc_id, '.txt ') END").alias("value"))
    return claim_lists.text_items(lines).select("ord", "claimed_path", "rel", "digest")


@query("SELECT conv_id, turn, concat('c/', CAST(conv_id AS STRING)) AS claimed_path, sha256(text) AS digest FROM conversations")
def claims_from_json(spark, sf_dir):
    """One JSON list of an object for each turn."""
    j = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("c/"), "conv_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.lit("").alias("md5"), F.concat_ws(",", "conv_id", "turn").alias("note"))).alias("files")))
    items = claim_lists.json_items(table(spark, sf_dir, "conversations").select(j.alias("value")))
    note = F.split(F.get_json_object("raw", "$.note"), ",")
    return items.select(note[0].cast("long").alias("conv_id"), note[1].cast("long").alias("turn"), "claimed_path", "digest")


@query("SELECT doc_id, source, lang, text FROM documents")
def delivered_rows(spark, sf_dir):
    """Documents as a list through the committing sink: what a second job overwrites is gone, what a third adds counts, each row once."""
    folder = delivery.mounted(shared_folder(spark)) + f"/delivery-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    spark.dataSource.register(delivery.Delivery)
    for rows, mode in ((docs.where("doc_id % 3 = 0"), "append"), (docs.where("doc_id % 2 = 0"), "overwrite"), (docs.where("doc_id % 2 <> 0 OR doc_id IS NULL"), "append")):
        rows.write.format("delivery").mode(mode).save(folder)
    return delivery.delivered(spark, folder, docs.schema)


@query("""SELECT doc_id AS "row", concat('C:/d/', CAST(doc_id AS STRING), '.txt') AS path, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE '' END AS md5, '.txt' AS ext, 'false' AS unparsed FROM documents""")
def canonical_list(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.expr("CASE doc_id % 3 WHEN 0 THEN concat(upper(md5(text)), '  C:/d/', doc_id, '.txt') ELSE concat('  C:/d/', doc_id, '.txt ') END").alias("value"))
    return claim_lists.canonical(claim_lists.text_items(lines)).select(F.col("row").cast("long").alias("row"), "path", "md5", "ext", "unparsed")


@query("SELECT event_id, 'f' || CAST(user_id AS STRING) || '.tmp' AS file_name, CAST(" + EVENT_MASK + " AS BIGINT) AS reason_mask, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp_utc FROM events")
def journal_from_cells(spark, sf_dir):
    """Journal rows without a header: cells told apart by shape; the USN is the event's number."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), "user_id", F.lit(".tmp")).alias("n"), F.concat(F.lit("0x"), F.lower(F.hex(F.expr(EVENT_MASK).cast("long")))).alias("m"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"))
    rows = e.select(F.col("event_id").alias("ord"), F.array("n", F.lit("0x00a1"), F.col("event_id").cast("string"), "t", "m").alias("cells"))
    return claim_lists.read_journal(rows).select(F.col("usn").alias("event_id"), "file_name", "reason_mask", "timestamp_utc")
