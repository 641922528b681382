"""Many needles at once against a plain search."""

import random

from pyspark.sql import functions as F

from tallywright.operators import custody, needles
from tallywright.session import ship


def test_against_plain_search(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("aBc/.목É ") for _ in range(rnd.randrange(0, 25))) for _ in range(300)] + [None, "", "abc", "abc"]
    asked = {"", "a", "목", "É", "ab", "zz", "ABC", "not there at all", "a" * 40, *["".join(rnd.choice("abC/.목é ") for _ in range(rnd.randrange(1, 7))) for _ in range(2500)]}
    ship(spark)
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = needles.contained(rows, F.col("t"), spark.createDataFrame([(a,) for a in [*asked, "a", None]], "needle string"))
    assert sorted((r["i"], r["needle"]) for r in got.select("i", "needle").collect()) == sorted((i, a) for i, t in enumerate(texts) if t is not None for a in asked if a.lower() in t.lower())
    assert got.columns == ["i", "t", "needle"]
    assert needles.contained(rows, F.col("t"), spark.createDataFrame([], "needle string")).count() == 0


def test_many_queries_at_once(spark):
    """50,000 queries, of which every fifth names an item and one a changed path only."""
    ship(spark)
    results = spark.range(10_000).select(F.format_string("C:\\docs\\%06d.hwp", "id").alias("claimed_path"), F.when(F.col("id") % 2 == 0, F.format_string("docs/%06d.hwp", "id")).alias("matched_path"))
    changes = spark.createDataFrame([("removed", "other/gone.bin"), ("unchanged", "other/same.bin"), ("added", "docs/000000.hwp.bak")], "change string, path string")
    queries = spark.range(50_000).select(F.format_string("%06d.HWP", "id").alias("query")).unionByName(spark.createDataFrame([("gone",), ("same",), ("nothing",)], "query string"))
    got = custody.inquire(results, changes, queries)
    assert got.where("source = 'item'").count() == 10_000 and got.select("query").distinct().count() == 10_001
    assert [tuple(r) for r in got.where("source = 'change'").collect()] == [("gone", "change", "other/gone.bin")]
