"""Scope criteria compiled to one column expression, with three-valued groups: true, false, or NULL for 'could not be evaluated'.

A profile is read once on the driver; evaluating it is plain column arithmetic inside whole-stage code. Digest sets, which may be
large, are the exception: they come in by a join.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

GROUPS = ("extensions", "filename_patterns", "keywords", "date_ranges", "path_include", "size_bytes", "hash_sets")


@dataclass(frozen=True)
class Keyword:
    term: str
    regex: bool = False
    where: str = "name"  # name, content or both
    case_sensitive: bool = False

    def hit(self, text: Column) -> Column:
        if self.regex:
            return text.rlike(self.term if self.case_sensitive else f"(?iu){self.term}")
        return text.contains(self.term) if self.case_sensitive else F.lower(text).contains(self.term.lower())


@dataclass(frozen=True)
class Profile:
    keywords: tuple[Keyword, ...] = ()
    extensions: tuple[str, ...] = ()
    filename_patterns: tuple[str, ...] = ()
    date_ranges: tuple[tuple[str, int | None, int | None], ...] = ()  # field without _ns, from, to
    path_include: tuple[str, ...] = ()
    path_exclude: tuple[str, ...] = ()
    size_min: int | None = None
    size_max: int | None = None
    hash_sets: tuple[str, ...] = field(default=())  # names; digests come as a DataFrame

    @classmethod
    def load(cls, path: str) -> Profile:
        """From a JSON file; raises ValueError for unknown criteria or expressions that don't compile."""
        return cls.parse(json.loads(Path(path).read_text(encoding="utf-8-sig")))

    @classmethod
    def parse(cls, raw: dict) -> Profile:
        c = raw.get("criteria", raw)
        known = {"keywords", "extensions", "filename_patterns", "date_ranges", "path_include", "path_exclude", "size_bytes", "hash_sets"}
        if extra := set(c) - known:
            raise ValueError(f"unknown criteria: {', '.join(sorted(extra))}")
        words = []
        for k in c.get("keywords", []):
            k = {"term": k} if isinstance(k, str) else k
            if k.get("regex"):
                re.compile(k["term"])
            words.append(Keyword(k["term"], bool(k.get("regex")), k.get("in", "name"), bool(k.get("case_sensitive"))))
        size = c.get("size_bytes") or {}
        return cls(
            tuple(words),
            tuple(e.lower() if e.startswith(".") else f".{e.lower()}" for e in c.get("extensions", [])),
            tuple(c.get("filename_patterns", [])),
            tuple((r["field"], iso_ns(r.get("from")), iso_ns(r.get("to"))) for r in c.get("date_ranges", [])),
            tuple(c.get("path_include", [])),
            tuple(c.get("path_exclude", [])),
            size.get("min"),
            size.get("max"),
            tuple(s["name"] for s in c.get("hash_sets", [])),
        )


def iso_ns(text: str | None) -> int | None:
    """A profile's date bound: ten characters are midnight UTC."""
    import datetime as dt

    if not text:
        return None
    t = dt.datetime.fromisoformat(text)
    t = t if t.tzinfo else t.replace(tzinfo=dt.UTC)
    return int((t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1)) * 1000


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _globs(patterns: tuple[str, ...], *texts: Column) -> Column:
    return _any([F.lower(t).rlike(paths.glob_to_regex(p.lower())) for p in patterns for t in texts])


def load_hash_sets(spark: SparkSession, profile_path: str) -> DataFrame | None:
    """digest, name of the digest lists that a profile names (hash_sets with file, relative to the profile); None if it has none.

    A line is a digest, or begins with one; blank lines and # lines are skipped."""
    raw = json.loads(Path(profile_path).read_text(encoding="utf-8-sig"))
    out = None
    for s in raw.get("criteria", raw).get("hash_sets", []):
        if "file" not in s:
            continue
        lines = spark.read.text(str(Path(profile_path).parent / s["file"]))
        one = lines.select(F.lower(F.regexp_extract("value", r"^\s*([0-9a-fA-F]{32,128})(?![0-9a-fA-F])", 1)).alias("digest"), F.lit(s["name"]).alias("name")).where("digest <> ''")
        out = one if out is None else out.unionByName(one)
    return out


def group_columns(profile: Profile, rel: Column, size: Column, times: dict[str, Column], content: Column | None = None, in_hash_set: Column | None = None) -> dict[str, Column]:
    """One nullable boolean for each criterion group that the profile uses, in evaluation order."""
    name = paths.basename(rel)
    out: dict[str, Column] = {}
    if profile.extensions:
        out["extensions"] = paths.extension(rel).isin(list(profile.extensions))
    if profile.filename_patterns:
        out["filename_patterns"] = _globs(profile.filename_patterns, name, rel)
    if profile.keywords:
        by_name = [k.hit(t) for k in profile.keywords if k.where in ("name", "both") for t in (name, rel)]
        by_content = [k for k in profile.keywords if k.where in ("content", "both")]
        hit = F.when(_any(by_name), F.lit(True)) if by_name else F.when(F.lit(False), F.lit(True))
        if by_content:
            text = F.lit(None).cast("string") if content is None else content
            out["keywords"] = hit.when(text.isNull(), F.lit(None).cast("boolean")).otherwise(_any([k.hit(text) for k in by_content]))
        else:
            out["keywords"] = hit.otherwise(F.lit(False))
    if profile.date_ranges:
        state = F.lit(False)
        for which, low, high in profile.date_ranges:  # an ordered fold: a later missing time makes an earlier hit unknown again
            t = times[which]
            inside = F.lit(True)
            if low is not None:
                inside = inside & (t >= low)
            if high is not None:
                inside = inside & (t <= high)
            state = F.when(t.isNull() | (t == 0), F.lit(None).cast("boolean")).when(inside, F.lit(True)).otherwise(state)
        out["date_ranges"] = state
    if profile.path_include:
        out["path_include"] = _globs(profile.path_include, rel)
    if profile.size_min is not None or profile.size_max is not None:
        s = F.coalesce(size, F.lit(0))
        fits = F.lit(True)
        if profile.size_min is not None:
            fits = fits & (s >= profile.size_min)
        if profile.size_max is not None:
            fits = fits & (s <= profile.size_max)
        out["size_bytes"] = fits
    if in_hash_set is not None:
        out["hash_sets"] = in_hash_set
    return out


def verdict(groups: dict[str, Column], excluded: Column) -> Column:
    """excluded, unverifiable, in_scope_partial, in_scope, borderline or out_of_scope, in that precedence."""
    if not groups:
        return F.when(excluded, F.lit("excluded")).otherwise(F.lit("out_of_scope"))
    known = [g.isNotNull() for g in groups.values()]
    present, missing = _any(known), _any([~k for k in known])
    all_true = F.lit(True)
    for g in groups.values():
        all_true = all_true & F.coalesce(g, F.lit(True))
    narrow, broad = present & all_true, _any([F.coalesce(g, F.lit(False)) for g in groups.values()])
    return (
        F.when(excluded, F.lit("excluded"))
        .when(~present, F.lit("unverifiable"))
        .when(narrow & missing, F.lit("in_scope_partial"))
        .when(narrow, F.lit("in_scope"))
        .when(broad, F.lit("borderline"))
        .when(missing, F.lit("unverifiable"))
        .otherwise(F.lit("out_of_scope"))
    )


def evaluate(files: DataFrame, profile: Profile, content: str | None = None, hash_sets: DataFrame | None = None) -> DataFrame:
    """files (path, size, mtime_ns, ctime_ns, atime_ns, sha256) with excluded, matched, narrow, broad, verdict added.

    hash_sets (digest): membership by a left join on distinct digests, which Spark broadcasts only if it is small."""
    held = files
    member = None
    if hash_sets is not None:
        keys = hash_sets.select(F.lower("digest").alias("_digest")).where("_digest IS NOT NULL").distinct().withColumn("_in_set", F.lit(True))
        held = files.join(keys, F.lower(F.col("sha256")) == F.col("_digest"), "left")
        member = F.when(F.col("sha256").isNull() | (F.col("sha256") == ""), F.lit(None).cast("boolean")).otherwise(F.col("_in_set").isNotNull())
    times = {n: F.col(f"{n}_ns") for n in ("mtime", "ctime", "atime") if f"{n}_ns" in files.columns}
    groups = group_columns(profile, F.col("path"), F.col("size"), times, F.col(content) if content else None, member)
    excluded = _globs(profile.path_exclude, F.col("path"), paths.basename(F.col("path")))
    named = held.withColumns({f"_g_{n}": c for n, c in groups.items()} | {"excluded": excluded})
    cols = {n: F.col(f"_g_{n}") for n in groups}
    present = _any([c.isNotNull() for c in cols.values()])
    both = F.lit(True)
    for c in cols.values():
        both = both & F.coalesce(c, F.lit(True))
    return named.withColumns({
        "matched": F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cols.items()])) if cols else F.array().cast("array<string>"),
        "narrow": present & both & ~F.col("excluded"),
        "broad": _any([F.coalesce(c, F.lit(False)) for c in cols.values()]) & ~F.col("excluded"),
        "verdict": verdict(cols, F.col("excluded")),
    }).drop(*[f"_g_{n}" for n in groups], "_digest", "_in_set")
