"""Operator 10 against a plain Python version and against true similarities."""

import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from tallywright.llm import fingerprint as fp


def signed(x):
    return x - 2**64 if x >= 2**63 else x



def shingle_hashes(text):
    words = [w for w in re.split("[ \t-\r]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    out = []
    for i in range(max(len(words) - 4, 1)):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        out.append(h)
    return out if words else []


def least_by_bin(text):
    bins = {}
    for h in shingle_hashes(text):
        b = h >> 57
        bins[b] = min(bins.get(b, h), h)
    return bins


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_equal_texts_and_edges(spark):
    rows = [(5, "one two three four five six seven"), (1, "One two three four five six seven"), (2, ""), (3, None), (4, " \n\t"), (9, "é" * 5), (7, "x"), (8, "a b")]
    got = {r["doc_id"]: r for r in fp.edited(docs_of(spark, rows)).collect()}
    assert len(got) == 8
    assert got[5]["fingerprint"] == got[1]["fingerprint"] and len(got[5]["fingerprint"]) == fp.BINS * 2
    assert got[2]["fingerprint"] == got[3]["fingerprint"] == got[4]["fingerprint"] == ""
    assert got[3]["near_next"] == 1.0 and got[4]["near_next"] == 1.0
    assert got[9]["n_chars"] == 5 and got[3]["n_chars"] == 0


def test_edited_text(spark):
    texts = {i * 3: "".join(chr(97 + (i * 7 + j) % 26) if j % 5 else " " for j in range(i * 11 % 47)) + "é" * (i % 3) for i in range(200)}
    old, fp.RANGE_DOCS = fp.RANGE_DOCS, 17
    try:
        got = {r["doc_id"]: r["edited_sha256"] for r in fp.edited(docs_of(spark, list(texts.items())).repartition(5)).collect()}
    finally:
        fp.RANGE_DOCS = old
    order = sorted(texts, reverse=True)
    for at, i in enumerate(order):
        t, nxt = texts[i], texts[order[(at + 1) % len(order)]]
        half = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest(), i


def test_bins_match_plain_version(spark):
    """With many shingles every bin is filled: the low bits are those of the least hash of each bin."""
    import random

    rnd = random.Random(3)
    text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(3000))
    least = least_by_bin(text)
    assert len(least) == fp.BINS
    expected = spark.createDataFrame([(b, signed(h)) for b, h in least.items()], "b int, h long").select("b", F.pmod(F.xxhash64("h", "b"), F.lit(256)).alias("x")).collect()
    got = fp.fingerprints(docs_of(spark, [(1, text)])).first()["fingerprint"]
    assert got == "".join(f"{r['x']:02x}" for r in sorted(expected))


def test_empty_bins_match_plain_version(spark):
    """Texts of few shingles: each empty bin has the value of the first filled bin on its own probe sequence."""
    import random

    rnd = random.Random(4)
    texts = {n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n)) for n in (1, 4, 5, 6, 9, 20, 60, 150, 400)}
    walks = {r["j"]: r["w"] for r in spark.range(fp.BINS).select(F.col("id").alias("j"), F.array(*[fp.probe(F.col("id").cast("int"), F.lit(t)) for t in range(fp.BINS)]).alias("w")).collect()}
    assert all(sorted(w) == list(range(fp.BINS)) for w in walks.values())
    expected = []
    for n, text in texts.items():
        least = least_by_bin(text)
        for j in range(fp.BINS):
            value = least[j] if j in least else next(least[c] for c in walks[j] if c in least)
            expected.append((n, j, signed(value)))
    low = spark.createDataFrame(expected, "n int, j int, h long").select("n", "j", F.pmod(F.xxhash64("h", "j"), F.lit(256)).alias("x")).collect()
    want = {n: "".join(f"{x:02x}" for _, x in sorted((r["j"], r["x"]) for r in low if r["n"] == n)) for n in texts}
    got = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(docs_of(spark, list(texts.items()))).collect()}
    assert got == want


def test_long_text(spark):
    """A text of 2 million characters is fingerprinted whole: a change at its end shows."""
    text = "word " * 300_000 + "one two three four five"
    rows = fp.fingerprints(docs_of(spark, [(1, text), (2, text + " six seven eight nine ten")])).collect()
    assert rows[0]["n_chars"] == len(text) and rows[0]["fingerprint"] != rows[1]["fingerprint"]


def test_likeness_follows_jaccard(spark):
    import random

    rnd = random.Random(5)
    rows, truth = [], {}
    for i in range(40):
        n = rnd.choice([12, 40, 150, 600])
        a = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for at in rnd.sample(range(n), n * (i % 8) // 40):
            b[at] = f"v{rnd.randrange(10**6)}"
        x, y = set(shingle_hashes(" ".join(a))), set(shingle_hashes(" ".join(b)))
        truth[i] = len(x & y) / len(x | y)
        rows.append((i, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    tables = fp._probe_tables(spark)
    got = df.select("i", fp.fingerprint(F.col("a"), tables).alias("a"), fp.fingerprint(F.col("b"), tables).alias("b")).select("i", fp.likeness(F.col("a"), F.col("b")).alias("s")).collect()
    errors = [abs(r["s"] - truth[r["i"]]) for r in got]
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.3


def test_no_rows_and_clashing_columns(spark):
    assert fp.edited(docs_of(spark, [])).count() == 0
    df = docs_of(spark, [(1, "a b c d e f")]).withColumn("fp", F.lit(1)).withColumn("fingerprint", F.lit("x")).withColumn("f", F.lit(2))
    assert fp.edited(df).first()["near_next"] == 1.0
    twice = docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "q")])
    assert fp.edited(twice).count() == 3
