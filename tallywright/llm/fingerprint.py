"""Operator 10, document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

DataFrame functions only. A text's distinct five-word shingles are hashed once; the top bits of a hash name its bin and
each bin keeps its least hash. An empty bin takes over the value of the first filled bin on its own probe sequence, the same
for every text: from a hashed start by a hashed odd step, so that every bin comes by (not a fresh draw at each step). Of each bin's value, re-hashed with the bin's number, the low 8 bits are kept.
The likeness of two fingerprints is the share of equal bins, corrected for the 1 in 256 that agree by chance.

Edge cases: words are split at ASCII white space and compared with a-z folded to lower case; a text of one to four words
is one shingle; a text without words (empty, null, white space) has the fingerprint '', like 1.0 to another such text and
0.0 to any other. Equal texts have equal fingerprints. Documents with equal ids follow one another by hash of the text;
a null id comes last. A sole document is its own next one. Ids are numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 128
LOW = 256
SHINGLE = 5
#: Documents of neighbouring ids are put side by side in ranges of about so many; at most MAX_RANGES ranges.
RANGE_DOCS = 1000
MAX_RANGES = 65_536
#: Steps on a bin's probe sequence before all filled bins are compared.
PROBES = 12


def bound(value: Column, use) -> Column:
    """Evaluates value once for all uses inside use()."""
    return F.transform(F.array(value), use)[0]


def probe(j: Column, t: Column) -> Column:
    """Bin on the probe sequence of bin j at step t: start and odd step from a hash of j, so all bins come by."""
    start, step = F.pmod(F.xxhash64(j, F.lit(1)), F.lit(BINS)), F.pmod(F.xxhash64(j, F.lit(2)), F.lit(BINS // 2)) * 2 + 1
    return F.pmod(start + step * t, F.lit(BINS)).cast("int")


def _probe_tables(spark) -> tuple[list[list[int]], list[list[int]]]:
    """probe() of every bin as literals (BINS * PROBES numbers), and the step at which bin j comes to bin c."""
    rows = spark.range(BINS).select(F.col("id").alias("j"), *[probe(F.col("id").cast("int"), F.lit(t)).alias(f"t{t}") for t in range(BINS)]).collect()
    full = [list(r)[1:] for r in sorted(rows)]
    steps = [[0] * BINS for _ in full]
    for j, row in enumerate(full):
        for t, c in enumerate(row):
            steps[j][c] = t
    return [row[1 : PROBES + 1] if row[0] == j else row[:PROBES] for j, row in enumerate(full)], steps


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 57).cast("int")  # 64 - log2(BINS)


def fingerprint(text: Column, tables: tuple) -> Column:
    """array<int> of BINS low bytes; empty for a text without words."""
    near, steps = tables
    near_lit, step_lit = (F.split(F.lit(",".join(str(c) for row in t for c in row)), ",").cast("array<int>") for t in (near, steps))  # folded to constants
    words = F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[ \\t-\\r]+"), lambda w: w != "")
    hashed = bound(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE))))
    least = bound(F.sort_array(hashed), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))

    def dense(m: Column) -> Column:
        return bound(F.transform(m, bin_of), lambda filled: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(m, F.array_position(filled, j).cast("int") - 1)))

    def first_filled(d: Column, m: Column, j: Column) -> Column:
        soon = F.get(F.filter(F.transform(F.sequence(j * PROBES, j * PROBES + (PROBES - 1)), lambda t: F.get(d, F.get(near_lit, t))), lambda x: x.isNotNull()), F.lit(0))
        late = F.array_min(F.transform(m, lambda x: F.named_struct(F.lit("step"), F.get(step_lit, j * BINS + bin_of(x)), F.lit("value"), x)))["value"]
        return F.coalesce(soon, late)

    packed = bound(
        least,
        lambda m: bound(
            dense(m),
            lambda d: F.transform(d, lambda x, j: F.pmod(F.xxhash64(F.coalesce(x, first_filled(d, m, j)), j), F.lit(LOW)).cast("int")),
        ),
    )
    return F.when(F.regexp_like(text, F.lit("[^ \\t-\\r]")), packed).otherwise(F.array().cast("array<int>"))


def as_string(bins: Column) -> Column:
    return F.concat_ws("", F.transform(bins, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, corrected for chance agreement of the kept bits."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) / F.lit(float(BINS))
    chance = 1.0 / LOW
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest((same - chance) / (1 - chance), F.lit(0.0)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row; any columns but doc_id and text are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tables = _probe_tables(docs.sparkSession)
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), as_string(fingerprint(text, tables)).alias("fingerprint"))


def _ranges(docs: DataFrame) -> tuple[list[int], dict[int, int]]:
    """Bounds between ranges of ids, and for each range's largest id the range that comes before it in descending order.

    Both have MAX_RANGES entries at most."""
    ids = docs.select(F.col("doc_id").alias("i"))
    n = ids.count()
    k = max(1, min(MAX_RANGES, n // RANGE_DOCS))
    bounds: list[int] = []
    if k > 1:
        bounds = sorted(set(ids.agg(F.percentile_approx("i", [x / k for x in range(1, k)], 20 * min(k, 5000))).first()[0] or []))
    heads = ids.where(F.col("i").isNotNull()).groupBy(_range(F.col("i"), bounds).alias("r")).agg(F.max("i").alias("h")).collect()
    order = sorted((r["r"], r["h"]) for r in heads)
    nulls = bool(ids.where(F.col("i").isNull()).limit(1).count())
    before = {h: (order[(at + 1) % len(order)][0]) for at, (_, h) in enumerate(order)}
    if nulls and order:  # null ids are the last range, -1; the largest id follows them
        before[order[-1][1]] = -1
    return bounds, before


def _range(i: Column, bounds: list[int]) -> Column:
    """How many bounds are below i, by a search in log2 steps; -1 for null."""
    if not bounds:
        return F.when(i.isNull(), F.lit(-1)).otherwise(F.lit(0))
    table, top = F.lit(bounds), 1 << len(bounds).bit_length()
    at = F.lit(0)
    found = F.aggregate(
        F.array(*[F.lit(top >> s) for s in range(len(bounds).bit_length() + 1)]),
        at,
        lambda low, step: F.when((low + step <= len(bounds)) & (F.get(table, low + step - 1) < i), low + step).otherwise(low),
    )
    return F.when(i.isNull(), F.lit(-1)).otherwise(found)


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is replaced by the start of the next document.

    Neighbours in descending id meet in one range of ids, so no task sorts the whole table; each range also gets a copy
    of the largest id of the range that follows. One shuffle moves the texts."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bounds, before = _ranges(docs)
    tables = _probe_tables(spark)
    own = _range(F.col("doc_id"), bounds)
    kind = dict(docs.dtypes)["doc_id"]
    heads = spark.createDataFrame(list(before.items()), f"_head {kind}, _before int")
    null_follows = F.lit(min((r for r in before.values() if r >= 0), default=-1))  # the lowest range
    marked = docs.join(F.broadcast(heads), F.col("doc_id") == F.col("_head"), "left")
    places = F.when(F.col("_before").isNotNull(), F.array(F.struct(own.alias("r"), F.lit(0).alias("f")), F.struct(F.col("_before").alias("r"), F.lit(1).alias("f")))).when(
        F.col("doc_id").isNull(), F.array(F.struct(own.alias("r"), F.lit(0).alias("f")), F.struct(null_follows.alias("r"), F.lit(1).alias("f")))
    ).otherwise(F.array(F.struct(own.alias("r"), F.lit(0).alias("f"))))
    rows = marked.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), fingerprint(F.col("text"), tables).alias("fp"), F.explode(places).alias("at"))
    inside = Window.partitionBy("at.r").orderBy("at.f", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    ahead = rows.select("doc_id", "text", "n_chars", "fp", F.col("at.f").alias("f"), F.lead("text").over(inside).alias("ahead"), F.lead("fp").over(inside).alias("ahead_fp"))
    mine = ahead.where("f = 0").select("doc_id", "text", "n_chars", "fp", F.coalesce("ahead", "text").alias("ahead"), F.coalesce("ahead_fp", "fp").alias("ahead_fp"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    changed = mine.select("doc_id", "n_chars", "fp", "ahead_fp", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("ahead"), F.lit(1), half)).alias("changed"))
    done = changed.select("doc_id", "n_chars", F.sha2("changed", 256).alias("edited_sha256"), "fp", "ahead_fp", fingerprint(F.col("changed"), tables).alias("efp"))
    return done.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("ahead_fp")).alias("near_next"))
