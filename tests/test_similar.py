"""Similar paths through grams against every pair's ratio by difflib: best, doubts, thresholds, short and odd texts, folders of any size."""

import difflib
import random

import pytest

from tallywright import queries
from tallywright.operators import resolve, similar
from tallywright.session import ship

KEY = str.maketrans("oil|szgq", "01115299")
DIR = "/root/testdata/sf0.001"


def key(text):
    return text.replace("\\", "/").lower().translate(KEY)


def outcome(rel, names):
    """(fuzzy_path, best, ambiguous), or None if no ratio is 0.77 or more."""
    scores = sorted(((difflib.SequenceMatcher(None, key(rel), key(p)).ratio(), p) for p in names), reverse=True)
    if not scores or scores[0][0] < similar.ACCEPT - similar.MARGIN:
        return None
    best, second = scores[0][0], scores[1][0] if len(scores) > 1 and scores[1][0] >= similar.ACCEPT - similar.MARGIN else 0.0
    clear = best >= 0.82 and best - second >= 0.05
    return scores[0][1] if clear else None, best, best >= 0.82 and not clear


def damaged(rnd, text, share, signs):
    out = []
    for c in text:
        x = rnd.random()
        out.append(c if x > share else rnd.choice(signs) if x > share / 2 else "" if x > share / 4 else c + rnd.choice(signs))
    return "".join(out)


@pytest.mark.parametrize(("signs", "lengths", "share"), [("abcdefgo0il1/.", (3, 40), 0.15), ("ab/", (1, 9), 0.3), ("가나다라마바/.1", (2, 25), 0.2), ("abcdefghijklmnopqrstuvwxyz/._-0123456789", (30, 260), 0.12)])
def test_against_every_pair(spark, signs, lengths, share):
    rnd = random.Random(len(signs))
    names = list({"".join(rnd.choice(signs) for _ in range(rnd.randrange(*lengths))) for _ in range(90)} - {""})
    names += [damaged(rnd, n, 0.06, signs) for n in names[:30]]  # near ones, so that there are doubts
    names = sorted({n for n in names if n})
    asked = sorted({damaged(rnd, n, rnd.choice([0.02, share, 2 * share]), signs) for n in names} - {""}) + names[:5]
    want = {rel: o for rel in asked if (o := outcome(rel, names))}
    ship(spark)
    files = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r["rel"]: (r["fuzzy_path"], r["best"], r["ambiguous"]) for r in resolve.fuzzy(spark.createDataFrame([(n,) for n in [*asked, "", None, asked[0]]], "rel string"), files).collect()}
    assert got == want
    kinds = {(p is not None, a) for p, _, a in got.values()}
    assert {(True, False), (False, True)} <= kinds


def test_grams_bound():
    """Two texts of a ratio share at least so many grams, and the tokens that they'd meet on."""
    import numpy as np

    rnd, often = random.Random(2), np.zeros(similar.REMAINDERS, np.int64)
    for _ in range(4000):
        a = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 30)))
        b = damaged(rnd, a, rnd.choice([0.05, 0.2, 0.4]), "abcd") or "a"
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        for least, q in similar.LEVELS:
            if ratio >= least:
                assert len(set(similar._grams(a, q)) & set(similar._grams(b, q))) >= similar.shared_grams(len(a) + len(b), ratio, q) - 1e-9
                assert set(similar.tokens(a, least, q, often)) & set(similar.tokens(b, least, q, often))


def test_no_files_or_claims(spark):
    ship(spark)
    none = spark.createDataFrame([], "path string")
    one = spark.createDataFrame([("a/b",)], "rel string")
    assert resolve.fuzzy(one, none).count() == 0 and resolve.fuzzy(one.limit(0), one.toDF("path")).count() == 0


def test_flat_folder(spark):
    """A folder of many files: claims meet what shares grams with them, with the result of all pairs; a file elsewhere never comes into question."""
    rnd = random.Random(4)
    inside = [f"big/{rnd.randrange(16**10):010x}-{i}.dat" for i in range(1500)]
    files = [*inside, "other/0123456789-1.dat", *[f"small/{c * 6}.txt" for c in "abcd"]]
    asked = [damaged(rnd, n, 0.08, "xyz") for n in inside[:60]]
    asked = [a if a.startswith("big/") else f"big/{a[4:]}" for a in asked] + ["big/0123456789-1.dat", "small/aaaxaa.txt", "small/none", "nowhere/x.dat", inside[0]]
    ship(spark)
    folders = spark.createDataFrame([("big",), ("small",), ("other",)], "path string")
    got = {r["rel"]: (r["path"], r["status"]) for r in resolve.scoped(spark.createDataFrame([(a,) for a in asked], "rel string"), spark.createDataFrame([(f,) for f in files], "path string"), folders).collect()}
    for rel in asked:
        top = rel.split("/")[0]
        found = (outcome(rel, [f for f in files if f.startswith(top + "/")]) or (None,))[0]
        want = (rel, "resolved_direct") if rel in files else (found, "resolved_fuzzy") if found else (None, "not_found")
        assert got[rel] == want, rel
    assert sum(s == "resolved_fuzzy" for _, s in got.values()) > 30


def test_damaged_documents_query(spark):
    names = [r["path"] for r in queries.stored(spark, DIR).collect()]
    got = {r["rel"]: (r["fuzzy_path"], r["best"], r["ambiguous"]) for r in queries.QUERIES["resolve_damaged"](spark, DIR).collect()}
    asked = []
    for r in queries.stored(spark, DIR).collect():
        letters, i = list(r["path"]), r["doc_id"] % 8 + 2
        letters[i] = "x"
        if r["doc_id"] % 10 == 0:
            letters[13] = "y"
        asked.append("".join(letters))
    assert got == {rel: o for rel in asked if (o := outcome(rel, names))}
    assert {round(b, 1) for _, b, _ in got.values()} >= {0.9, 1.0}
