"""Blocks of texts: bounds from above, and no shuffle of pairs where names are alike throughout."""

import difflib
import random

from pyspark.sql import functions as F

from tallywright.operators import resolve, similar
from tallywright.session import ship


def shuffled(spark):
    """Rows that all stages so far wrote to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_are_not_shuffled(spark):
    """4,000 names that share most grams, claims that are near none and claims that are near many: rows shuffled stay in proportion to texts."""
    ship(spark)
    files = spark.range(4000).select(F.format_string("docs/src%d/en/%d.txt", F.col("id") % 20, F.col("id") * 7).alias("path"))
    gone = spark.range(1000).select(F.format_string("gone/%d.bin", F.col("id") * 9).alias("rel"))
    near = files.limit(1000).select(F.overlay("path", F.lit("x"), F.lit(2)).alias("rel"))
    before = shuffled(spark)
    got = resolve.fuzzy(gone.unionByName(near), files).collect()
    assert len(got) == 1000 and all(r["rel"].startswith("dxcs") and r["best"] > 0.94 for r in got)
    assert shuffled(spark) - before < 20 * 6000


def test_signatures_bound_matches():
    """A signature never misses more of another's characters than the ratio's blocks do."""
    rnd = random.Random(3)
    for signs in ("ab/", "abcdefghij0123456789./_-", "가나다라마bc/", "aA#?é"):
        texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 70))) for _ in range(60)]
        bits = similar.signatures(texts)
        for a, x in zip(texts, bits.T, strict=True):
            for b, y in zip(texts, bits.T, strict=True):
                missing = sum(int(u & ~v).bit_count() for u, v in zip(x, y, strict=True))
                matched = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
                assert matched <= len(a) - missing


def test_large_folder_is_many_tasks_work(spark, monkeypatch):
    """A folder above LARGE gives what a smaller one does."""
    ship(spark)
    rnd = random.Random(8)
    names = [f"{top}/{rnd.randrange(16**9):09x}.dat" for top in ("big", "small") for _ in range(300 if top == "big" else 40)]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    folders = spark.createDataFrame([("big",), ("small",)], "path string")
    asked = spark.createDataFrame([(n.replace("a", "x", 1),) for n in names], "rel string")
    want = sorted(map(tuple, resolve.scoped(asked, files, folders).collect()))
    monkeypatch.setattr(resolve, "LARGE", 100)
    assert sorted(map(tuple, resolve.scoped(asked, files, folders).collect())) == want
    assert sum(s == "resolved_fuzzy" for *_, s in want) > 50


def test_claims_out_of_reach_leave_before_the_search(spark, monkeypatch):
    """Claims that no path can resemble are never searched for; the others' outcomes stay, also where both kinds come together or no claim or file is there."""
    ship(spark)
    searched, search = [], similar._searched
    monkeypatch.setattr(similar, "_searched", lambda open_, *rest: searched.append(open_.count()) or search(open_, *rest))
    names = [f"docs/src{i % 20}/en/{i * 7}.txt" for i in range(600)]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    gone = spark.range(500).select(F.format_string("gone/%d.bin", F.col("id") * 9).alias("rel"))
    near = files.limit(40).select(F.overlay("path", F.lit("x"), F.lit(2)).alias("rel"))
    assert resolve.fuzzy(gone, files).collect() == [] and resolve.fuzzy(gone, files.limit(0)).collect() == [] and resolve.fuzzy(gone.limit(0), files).collect() == []
    assert sum(searched) == 0
    alone = sorted(map(tuple, resolve.fuzzy(near, files).collect()))
    assert len(alone) == 40 and sum(searched) > 0
    assert sorted(map(tuple, resolve.fuzzy(gone.unionByName(near), files).collect())) == alone
    key = lambda n: n.lower().translate(str.maketrans("oil|szgq", "01115299"))
    for rel, _, best, _ in alone[:10]:
        assert abs(best - max(difflib.SequenceMatcher(None, key(rel), key(n)).ratio() for n in names)) < 1e-9
