"""A case from inputs to result tables, and the command line over the library's data commands.

python -m tallywright.case COMMAND ... ; COMMAND --help lists its arguments. Inventories are Parquet tables of schema.FILES, lists what
claims.read_claims reads. Each step writes its table before the next reads it, so a failed run goes on from there.
Exit codes: 2 for unusable arguments, 1 for a failed run, 130 after an interrupt."""

from __future__ import annotations

import argparse
import datetime as dt
import hashlib
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import artifacts, audit, boundary, certificate, custody, diff, evidence, inventory, journal, procedure, resolve, scan, verify
from .plans.criteria import Profile, iso_ns, load_hash_sets
from .session import ship
from .sources import reports, tree
from .sources.claims import canonical, read_claims, read_journal

LATEST = 2**63 - 1


def run_case(
    spark: SparkSession, files: DataFrame, items: DataFrame, profile: Profile, out: str, current: DataFrame | None = None, since_ns: int | None = None, until_ns: int | None = None,
    events: DataFrame | None = None, package: DataFrame | None = None, contents: DataFrame | None = None, hash_sets: DataFrame | None = None, inputs: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Result tables by name, each written below out. events: a journal (journal.decode); package: a certificate's files (path, content);
    contents: files with content, for artifacts. inputs: digests or names of what the case was made from, for the manifest."""
    ship(spark)
    made: dict[str, DataFrame] = {}
    log: list[tuple[str, str, str | None]] = []

    def keep(name: str, make: Callable[[], DataFrame], when: bool = True) -> None:
        """A step that fails is logged and the others go on; one whose inputs are missing is logged as skipped."""
        if not when:
            log.append((name, "skipped", None))
            return
        try:
            made[name] = reports.write_table(make(), out, name)
            log.append((name, "ok", None))
        except Exception as e:  # recorded as a row of steps: one broken input mustn't cost the rest of a case
            log.append((name, "failed", str(e).splitlines()[0][:500] if str(e) else type(e).__name__))

    terms = [k.term for k in profile.keywords]
    until = until_ns if until_ns is not None else LATEST
    keep("scan", lambda: scan.scan(files, profile, hash_sets=hash_sets))
    keep("scan_summary", lambda: scan.counters(files, profile, hash_sets=hash_sets))
    keep("verify", lambda: verify.verify(items, files, profile, hash_sets=hash_sets))
    done = "verify" in made
    keep("verify_summary", lambda: verify.summary(made["verify"]), done)
    keep("boundary", lambda: boundary.territories(made["verify"].select("ord", "claimed_path")), done)
    keep("keyword_audit", lambda: audit.keyword_audit(made["verify"], terms), done and bool(terms))
    keep("keyword_noise", lambda: audit.overall(made["verify"], terms), done and bool(terms))
    keep("diff", lambda: diff.diff(files, current), current is not None)
    keep("diff_summary", lambda: diff.summary(made["diff"]), "diff" in made)
    keep("disposal", lambda: custody.numbered_lists(custody.disposal_lists(made["verify"], made.get("diff"))), done)
    keep("petition", lambda: custody.petition_items(made["verify"]), done)
    keep("petition_grounds", lambda: custody.petition_grounds(made["verify"], made.get("diff"), made.get("boundary"), made.get("keyword_audit"), made.get("keyword_noise")), done)
    keep("tools", lambda: evidence.observed_tools(files))
    keep("journal", lambda: journal.notable(events), events is not None)
    keep("journal_summary", lambda: journal.histogram(events), events is not None)
    keep("window", lambda: journal.window(files, since_ns, until), since_ns is not None)
    keep("window_summary", lambda: journal.window_summary(made["window"], files), "window" in made)
    keep("leftovers", lambda: evidence.leftovers(files, since_ns, until_ns, journal.deletions(events) if events is not None else None), since_ns is not None)
    keep("containers", lambda: evidence.containers(files, since_ns))
    keep("certificate", lambda: certificate.package_findings(certificate.members(package), files if {"md5", "sha1"} <= set(files.columns) else None), package is not None)
    keep("artifacts", lambda: artifacts.matched(contents, since_ns).drop("content"), contents is not None)
    keep("artifact_tools", lambda: artifacts.observed(contents, since_ns), contents is not None)
    keep("manifest", lambda: reports.manifest(spark, "case", dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), (inputs or {}) | {"criteria": reports.canonical_json_hash(repr(profile))}))
    made["steps"] = reports.write_table(spark.createDataFrame(log, "step string, status string, error string"), out, "steps")
    return made


# --- commands: each gives the tables that it writes, the first of them shown as a summary where it's small


def _profile(spark: SparkSession, a: argparse.Namespace) -> tuple[Profile, DataFrame | None]:
    return Profile.load(a.profile), load_hash_sets(spark, a.profile)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _bytes(spark: SparkSession, path: str) -> DataFrame:
    """path below the folder, size, mtime_ns, content of all files in it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = "file:" + str(Path(path).resolve()).rstrip("/") + "/"
    rel = F.when(F.startswith("path", F.lit(root)), F.substring("path", len(root) + 1, 1 << 20)).otherwise(F.col("path"))
    return raw.select(rel.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.lit("file").alias("kind"), "content")


def _digest(path: str) -> str:
    """Of a file's content; of a folder the name."""
    if not Path(path).is_file():
        return str(path)
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _scan(spark, a):
    profile, sets = _profile(spark, a)
    files = _files(spark, a.inventory)
    return {"summary": scan.counters(files, profile, hash_sets=sets), "hits": scan.scan(files, profile, hash_sets=sets)}


def _verify(spark, a):
    profile, sets = _profile(spark, a) if a.profile else (None, None)
    rows = verify.verify(read_claims(spark, a.claims), _files(spark, a.inventory), profile, _files(spark, a.live) if a.live else None, hash_sets=sets)
    return {"summary": verify.summary(rows), "items": rows}


def _diff(spark, a):
    rows = diff.diff(_files(spark, a.inventory), _files(spark, a.current), iso_ns(a.created))
    return {"summary": diff.summary(rows), "changes": rows}


def _inventory(spark, a):
    """The table files is written by the job itself."""
    rows = tree.take_inventory(spark, a.root, a.out, a.hash, _files(spark, a.earlier) if a.earlier else None, int(a.max_hash_bytes) if a.max_hash_bytes else None)
    rows = rows if a.earlier else rows.drop("reused")
    return {"summary": inventory.meta(rows, a.root, dt.datetime.now(dt.UTC).isoformat(timespec="seconds"))}


def _boundary(spark, a):
    rows = boundary.territories(read_claims(spark, a.claims))
    return {"summary": boundary.counts(rows), "items": rows.select("ord", "claimed_path", "territory", "violation")}


def _audit(spark, a):
    profile, sets = _profile(spark, a)
    rows, terms = verify.verify(read_claims(spark, a.claims), _files(spark, a.inventory), profile, hash_sets=sets), [k.term for k in profile.keywords]
    return {"summary": audit.overall(rows, terms), "keywords": audit.keyword_audit(rows, terms)}


def _journal(spark, a):
    raw = spark.read.csv(a.export)
    cells = raw.select(F.monotonically_increasing_id().alias("ord"), F.array(*raw.columns).alias("cells"))
    events = journal.select(journal.decode(read_journal(cells)), a.since, a.name)
    return {"summary": journal.histogram(events), "events": events}


def _window(spark, a):
    files = _files(spark, a.inventory)
    hits = journal.window(files, iso_ns(a.since), iso_ns(a.until) or LATEST)
    return {"summary": journal.window_summary(hits, files), "hits": journal.window_order(hits)}


def _leftovers(spark, a):
    rows = evidence.leftovers(_files(spark, a.inventory), iso_ns(a.since), iso_ns(a.until))
    return {"summary": evidence.leftover_summary(rows), "items": rows}


def _containers(spark, a):
    rows = evidence.containers(_files(spark, a.inventory), iso_ns(a.since))
    return {"summary": rows.agg(F.count("*").alias("containers"), F.sum("size").alias("bytes")), "items": rows}


def _sources(spark, a):
    rows = _files(spark, a.inventory).withColumn("reason", evidence.source_reason(F.col("path"), F.col("mtime_ns"), iso_ns(a.since))).where("reason IS NOT NULL")
    return {"summary": rows.groupBy("reason").count(), "items": rows}


def _mobile(spark, a):
    rows = _files(spark, a.inventory).withColumn("target", evidence.mobile_target(F.col("path"))).where("target IS NOT NULL")
    return {"summary": rows.groupBy("target").count(), "items": rows}


def _artifacts(spark, a):
    held = artifacts.matched(_bytes(spark, a.root), iso_ns(a.since))
    signs = artifacts.observed(_bytes(spark, a.root), iso_ns(a.since))
    return {"summary": artifacts.summary(held), "files": held.drop("content"), "signs": signs, "tools": artifacts.tools(signs), "timelines": artifacts.timelines(held.where("category = 'evtx'"), artifacts.events(held.where("category = 'evtx'")))}


def _certificate(spark, a):
    parts = certificate.members(_bytes(spark, a.package))
    found = certificate.package_findings(parts, _files(spark, a.live) if a.live else None)
    return {"summary": certificate.package_summary(parts, found), "findings": found}


def _convert(spark, a):
    items = read_claims(spark, a.claims)
    return {"summary": items.agg(F.count("*").alias("items"), F.count_if("unparsed").alias("unparsed")), "list": canonical(items)}


def _mirror(spark, a):
    files, items = _files(spark, a.inventory), read_claims(spark, a.claims)
    found = resolve.scoped(items.where("NOT unparsed"), files.where("kind = 'file'"), files.where("kind = 'dir'"))
    return {"summary": found.groupBy("status").count(), "plan": custody.mirror_plan(items.where("NOT unparsed"), files), "resolved": found}


def _seal(spark, a):
    sums = _files(spark, a.inventory).where("sha256 IS NOT NULL").select(F.lit("all").alias("archive"), F.col("path").alias("rel"), F.col("sha256").alias("digest"))
    return {"summary": custody.root_hash(sums, "archive")}


def _sums(spark, a):
    verdicts = custody.check_sums(reports.checksum_list(spark.read.text(a.sums)), _files(spark, a.inventory).select(F.col("path").alias("name"), F.col("sha256").alias("digest")))
    return {"summary": custody.overall(verdicts), "files": verdicts}


def _procedure(spark, a):
    """The case's log, and the digests of all its files."""
    rows = procedure.log(procedure.steps(procedure.read_manifests(spark, a.case)), procedure.watches(procedure.read_events(spark, a.case)))
    index = tree.take_inventory(spark, a.case, a.out).where("kind = 'file'")
    return {"summary": rows.agg(F.count("*").alias("entries"), F.min("ts").alias("first"), F.max("ts").alias("last")), "log": rows, "index": index.select("path", "size", "sha256", "status")}


def _rejoin(spark, a):
    parts = reports.parts(_bytes(spark, a.parts))
    told = reports.checksum_list(spark.read.text(a.sums)).select(F.col("name").alias("archive"), "digest")
    rows = custody.rejoined(parts, told)
    return {"summary": rows.groupBy("verdict").count(), "archives": rows, "parts": custody.check_sums(reports.checksum_list(spark.read.text(a.sums)), parts.select(F.col("path").alias("name"), F.sha2("content", 256).alias("digest")))}


def _inquiry(spark, a):
    results, changes = (reports.case_table(spark, a.case, n) for n in ("verify", "diff"))
    if results is None:
        raise ValueError("the case has no verify results")
    none = spark.createDataFrame([], "change string, path string")
    return {"summary": custody.inquire(results, changes if changes is not None else none, spark.createDataFrame([(q,) for q in a.query], "query string"))}


def _petition(spark, a):
    tables = {n: reports.case_table(spark, a.case, n) for n in ("verify", "diff", "boundary", "keyword_audit", "keyword_noise")}
    if tables["verify"] is None:
        raise ValueError("the case has no verify results")
    return {"summary": custody.petition_grounds(tables["verify"], tables["diff"], tables["boundary"], tables["keyword_audit"], tables["keyword_noise"]), "items": custody.petition_items(tables["verify"]), "lists": custody.numbered_lists(custody.disposal_lists(tables["verify"], tables["diff"]))}


def _case(spark, a):
    profile, sets = _profile(spark, a)
    cells = spark.read.csv(a.journal) if a.journal else None
    events = journal.decode(read_journal(cells.select(F.monotonically_increasing_id().alias("ord"), F.array(*cells.columns).alias("cells")))) if cells is not None else None
    names = {n: _digest(getattr(a, n)) for n in ("inventory", "claims", "profile", "current", "journal", "package", "artifacts") if getattr(a, n)}
    made = run_case(
        spark, _files(spark, a.inventory), read_claims(spark, a.claims), profile, a.out, _files(spark, a.current) if a.current else None, iso_ns(a.since), iso_ns(a.until),
        events, _bytes(spark, a.package) if a.package else None, _bytes(spark, a.artifacts) if a.artifacts else None, sets, names,
    )
    return {"summary": made.get("verify_summary", made["steps"])}


#: Each command with its needed and its other arguments; paths are checked before Spark is started.
COMMANDS: dict[str, tuple[Callable, tuple[str, ...], tuple[str, ...]]] = {
    "case": (_case, ("inventory", "claims", "profile", "out"), ("current", "since", "until", "journal", "package", "artifacts")),
    "inventory": (_inventory, ("root", "out"), ("earlier", "hash", "max_hash_bytes")),
    "scan": (_scan, ("inventory", "profile", "out"), ()),
    "verify": (_verify, ("inventory", "claims", "out"), ("profile", "live")),
    "diff": (_diff, ("inventory", "current", "out"), ("created",)),
    "boundary": (_boundary, ("claims", "out"), ()),
    "keyword-audit": (_audit, ("inventory", "claims", "profile", "out"), ()),
    "journal": (_journal, ("export", "out"), ("since", "name")),
    "window": (_window, ("inventory", "since", "out"), ("until",)),
    "leftovers": (_leftovers, ("inventory", "out"), ("since", "until")),
    "containers": (_containers, ("inventory", "out"), ("since",)),
    "sources": (_sources, ("inventory", "out"), ("since",)),
    "mobile": (_mobile, ("inventory", "out"), ()),
    "artifacts": (_artifacts, ("root", "out"), ("since",)),
    "certificate": (_certificate, ("package", "out"), ("live",)),
    "convert": (_convert, ("claims", "out"), ()),
    "mirror": (_mirror, ("inventory", "claims", "out"), ()),
    "seal": (_seal, ("inventory", "out"), ()),
    "check-sums": (_sums, ("sums", "inventory", "out"), ()),
    "procedure": (_procedure, ("case", "out"), ()),
    "rejoin": (_rejoin, ("parts", "sums", "out"), ()),
    "inquiry": (_inquiry, ("case", "query", "out"), ()),
    "petition": (_petition, ("case", "out"), ()),
}
#: Arguments that name something that must be there.
PATHS = ("inventory", "claims", "profile", "current", "journal", "package", "artifacts", "root", "earlier", "live", "export", "sums", "case", "parts")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallywright")
    every = p.add_subparsers(dest="command", required=True)
    for name, (_, needed, others) in COMMANDS.items():
        one = every.add_parser(name)
        for n in needed:
            one.add_argument(f"--{n}", required=True, **({"nargs": "+"} if n == "query" else {}))
        for n in others:
            one.add_argument(f"--{n}", **({"action": "store_true"} if n == "hash" else {}))
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    for n in PATHS:
        at = getattr(args, n, None)
        if at and "://" not in at and not Path(at).exists():
            p.error(f"--{n}: {at} isn't there")
    for n in ("since", "until", "created"):
        if getattr(args, n, None):
            try:
                iso_ns(getattr(args, n))
            except ValueError:
                p.error(f"--{n}: not a time")
    try:
        spark = SparkSession.builder.appName(args.command).config("spark.sql.session.timeZone", "UTC").getOrCreate()
        ship(spark)
        tables = COMMANDS[args.command][0](spark, args)
        summary = reports.write_table(tables.pop("summary"), args.out, "summary")
        for name, df in tables.items():
            reports.write_table(df, args.out, name)
        print(reports.summary_json(summary))
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
