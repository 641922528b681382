"""Column functions and the criteria compiler, on literal inputs."""

import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from tallywright.functions import digests, paths, reasons, timeutil
from tallywright.operators import boundary, evidence
from tallywright.plans.criteria import Keyword, Profile, evaluate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024-05-01 12:00:00", "2024-05-01T12:00:00+00:00"), ("5/1/2024 09:08:07", "2024-05-01T09:08:07+00:00"), ("0x1DA9B80C0A7C000", None), ("x", None), ("133589952000000000", "2024-05-01T00:00:00+00:00")],
)
def test_usn_time(spark, text, want):
    got = one(spark, timeutil.usn_time(F.lit(text)))
    assert got == want if not text.startswith("0x") else got.startswith("20")


@pytest.mark.parametrize(
    ("text", "want"),
    [("2025. 1. 11. 오후 1:28", "2025-01-11 13:28:00"), ("2025-01-02", "2025-01-02 00:00:00"), ("2025년 3월 4일 오전 12시 5분", "2025-03-04 00:05:00"), ("모름", None), ("2025-13-45", None), ("2026-02-01 12:00:00", "2026-02-01 12:00:00")],
)
def test_lenient_datetime(spark, text, want):
    got = one(spark, timeutil.lenient_datetime(F.lit(text)))
    assert (None if got is None else str(got)) == want


def test_times(spark):
    assert one(spark, timeutil.iso_to_ns(F.lit("1970-01-02"))) == 86400 * 10**9
    assert one(spark, timeutil.iso_to_ns(F.lit("1970-01-01T00:00:01Z"))) == 10**9
    assert one(spark, timeutil.iso_to_ns(F.lit("no"))) is None
    assert one(spark, timeutil.ns_to_iso(F.lit(1_999_999_999))) == "1970-01-01T00:00:01+00:00"
    assert one(spark, timeutil.filetime_to_iso(F.lit(0))) is None


@pytest.mark.parametrize("pattern", ["*.txt", "a?c", "[abc]*", "[!a]x", "*초안*", "a[x[y]b", "a.b+c", "[", "x[&&]y", "sys/*", "[]]a", "[!]]a", "^a$"])
def test_glob_matches_fnmatch(spark, pattern):
    texts = ["a.txt", "abc", "bx", "ax", "계약_초안.hwp", "axb", "a[b", "a.b+c", "[", "x&y", "sys/a/b", "]a", "xa", "^a$", "c\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(paths.glob_to_regex(pattern)).alias("m")).collect()
    assert {r["t"]: r["m"] for r in got} == {t: fnmatch.fnmatchcase(t, pattern) for t in texts}


def test_paths(spark):
    assert one(spark, paths.normalise(F.lit("  C:\\docs\\\\a//b.txt "))) == "docs/a/b.txt"
    assert one(spark, paths.suffixes(F.lit("a/b/c"))) == ["b/c", "c"]
    assert one(spark, paths.suffixes(F.lit("a"))) == []
    assert one(spark, paths.ancestors(F.lit("a/b/c"))) == ["a", "a/b"]
    assert one(spark, paths.extension(F.lit("x/.Profile"))) == ".profile"
    assert one(spark, paths.extension(F.lit("x.y/noext"))) == ""
    assert one(spark, paths.fuzzy_key(F.lit("OIL\\Sz"))) == "011/52"


def test_reasons(spark):
    for mask in (0x80000102, 0x1200, 0, 0x201):
        names = [n for b, n in reasons.REASONS.items() if mask & b]
        assert one(spark, reasons.names(F.lit(mask))) == names
        assert one(spark, reasons.mask(F.lit("|".join(n.title() for n in names)))) == mask
    assert one(spark, reasons.mask(F.lit("FileCreate | Close"))) == 0x80000100
    assert one(spark, digests.number(F.lit("0x1F"))) == 31 and one(spark, digests.number(F.lit("017"))) is None


FILES = "path string, size long, mtime_ns long, ctime_ns long, atime_ns long, sha256 string, content string"


def verdicts(spark, profile, rows, hash_sets=None):
    df = spark.createDataFrame(rows, FILES)
    return {r["path"]: (r["verdict"], r["matched"]) for r in evaluate(df, profile, content="content", hash_sets=hash_sets).collect()}


def test_verdict_never_calls_unknown_false(spark):
    p = Profile(keywords=(Keyword("contract", where="content"),), extensions=(".txt",))
    rows = [("a.txt", 1, 1, 1, 1, None, "the Contract"), ("b.txt", 1, 1, 1, 1, None, None), ("c.doc", 1, 1, 1, 1, None, None), ("d.doc", 1, 1, 1, 1, None, "no"), ("e.doc", 1, 1, 1, 1, None, "contract")]
    got = verdicts(spark, p, rows)
    assert got["a.txt"] == ("in_scope", ["extensions", "keywords"])
    assert got["b.txt"][0] == "in_scope_partial"
    assert got["c.doc"][0] == "unverifiable"
    assert got["d.doc"][0] == "out_of_scope"
    assert got["e.doc"] == ("borderline", ["keywords"])
    assert verdicts(spark, Profile(), rows[:1])["a.txt"][0] == "out_of_scope"
    assert verdicts(spark, Profile(path_exclude=("*.TXT",), extensions=(".txt",)), rows[:1])["a.txt"][0] == "excluded"
    only_content = Profile(keywords=(Keyword("x", where="content"),))
    assert verdicts(spark, only_content, rows[1:2])["b.txt"][0] == "unverifiable"


def test_date_ranges_fold_in_order(spark):
    hit, gone = ("mtime", 0, 10), ("ctime", 0, 10)
    rows = [("x", 1, 5, 0, 1, None, None)]
    assert verdicts(spark, Profile(date_ranges=(hit, gone)), rows)["x"][0] == "unverifiable"
    assert verdicts(spark, Profile(date_ranges=(gone, hit)), rows)["x"][0] == "in_scope"


def test_hash_sets(spark):
    p = Profile(hash_sets=("s",))
    rows = [("in", 1, 1, 1, 1, "AB", None), ("out", 1, 1, 1, 1, "cd", None), ("none", 1, 1, 1, 1, None, None)]
    got = verdicts(spark, p, rows, spark.createDataFrame([("ab",), ("ab",), (None,)], "digest string"))
    assert [got[k][0] for k in ("in", "out", "none")] == ["in_scope", "out_of_scope", "unverifiable"]


def test_profile_errors():
    with pytest.raises(re.error):
        Profile.parse({"criteria": {"keywords": [{"term": "(", "regex": True}]}})
    with pytest.raises(ValueError, match="unknown criteria"):
        Profile.parse({"criteria": {"colour": 1}})
    p = Profile.parse({"keywords": ["a"], "extensions": ["HWP"], "date_ranges": [{"field": "mtime", "from": "1970-01-02"}]})
    assert p.extensions == (".hwp",) and p.date_ranges[0][1] == 86400 * 10**9


def test_places_and_names(spark):
    items = [("\\\\srv\\x", "remote_unc"), ("C:\\Users\\OneDrive - 회사\\a", "cloud_sync"), ("C:\\XboxGaming\\a", "local_unverified"), ("D:\\box\\a", "cloud_sync"), ("", "unknown"), (None, "unknown"), ("C:\\네이버리뷰링크\\a", "local_unverified")]
    got = boundary.territories(spark.createDataFrame([(p,) for p, _ in items], "claimed_path string")).collect()
    assert sorted((r["claimed_path"] or "", r["territory"]) for r in got) == sorted((p or "", t) for p, t in items)
    volumes = spark.createDataFrame([("D:", "removable"), ("E", "fixed")], "drive string, type string")
    got = boundary.territories(spark.createDataFrame([('"D:\\x"',), (" e:\\y ",), ('"\\\\srv\\z"',)], "claimed_path string"), volumes).collect()
    assert sorted((r["territory"], r["violation"]) for r in got) == [("local_fixed", False), ("remote_unc", True), ("removable", True)]
    quiet = ["deselectedTab_1x1.gif", "DevDispItemProvider.dll", "gpresult.exe", "ExtExport.exe", "DXToolsReporting.dll"]
    loud = {"selected_files.txt": "list_named", "forensic-report.pdf": "list_named", "압수물목록.xlsx": "list_named", "a.zip": "container_in_window", "x.pdf": "possible_list"}
    for n in quiet:
        assert one(spark, evidence.leftover_category(F.lit(n))) is None, n
    for n, c in loud.items():
        assert one(spark, evidence.leftover_category(F.lit(n))) == c
    assert one(spark, evidence.leftover_category(F.lit("x.pdf"), bounded=False)) is None
    assert one(spark, evidence.mobile_target(F.lit("Users/a/AppData/Local/Kakao/KakaoTalk/x/y"))) == "kakaotalk_pc"
    assert one(spark, evidence.artifact_category(F.lit("Windows/Prefetch/A.EXE-1.pf"))) == "prefetch"
    assert one(spark, evidence.tool_label(F.lit("FTKImager"))) == "FTK Imager"
