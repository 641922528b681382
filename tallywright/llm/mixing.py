"""Operator 3, mixing sources to target weights: Pfair scheduling of source blocks, earliest deadline first.

Each source's texts, in an order drawn by hash, fill blocks of BLOCK_BYTES bytes. Weights are whole numbers a of a period of Q
slots. Block i of a source is released at slot floor(i Q / a) and due by slot ceil((i + 1) Q / a); each slot goes to the
released block with the earliest deadline. As the weights sum to Q, the schedule repeats after Q slots and at any slot a
source has had its due share within less than one block. Only one period is simulated, on the driver, whatever the size
of the corpus; where a block falls follows by arithmetic.

The mix goes on to the last of the deadlines of all sources' last blocks, so that every block of every source is used once; sources with less text than their weight asks
for go round again (epoch 1, 2, ...). No document is dropped.

Edge cases: a null source is a source of its own; empty and null texts count as one byte; documents with equal ids keep
separate places; an empty table gives no rows; sources without a given weight get weight 0 only if weights are given, and
then a ValueError says so, since they'd be dropped.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 16
#: Slots in a period; the schedule table has as many entries. Doubled until each source has two slots on average.
PERIOD = 4096
MAX_SOURCES = 50_000
#: Without given weights a source weighs its bytes to this power.
TEMPERATURE = 0.7
#: Texts of a source are put in order in groups of about so many.
GROUP_ROWS = 20_000


def whole_weights(weights: dict[str, float], period: int = PERIOD) -> tuple[dict[str, int], int]:
    """Weights as whole numbers of slots, each 1 at least, and the period they sum to. Largest remainders go up."""
    while period < 2 * len(weights):
        period *= 2
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (slots[s] - exact[s], s))
    spare = period - sum(slots.values())
    for k in range(max(spare, 0)):
        slots[order[k % len(order)]] += 1
    while sum(slots.values()) > period:  # small sources were raised to 1
        slots[max(slots, key=lambda s: (slots[s] - exact[s], slots[s], s) if slots[s] > 1 else (-period, 0, s))] -= 1
    return slots, period


def schedule(slots: dict[str, int], period: int) -> dict[str, list[int]]:
    """The slots that each source gets in one period, by earliest deadline first among released blocks."""
    waiting = [(0, s, 0) for s in sorted(slots)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in slots}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // slots[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out[s].append(t)
        if i + 1 < slots[s]:
            heapq.heappush(waiting, ((i + 1) * period // slots[s], s, i + 1))
    return out


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def place(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, period: int = PERIOD) -> DataFrame:
    """doc_id, source, block, epoch, slot, offset (bytes before the document within its block) for each time a document comes in the mix.

    Ordering by slot, then offset, gives the mixed stream. A hot source is dealt over groups by hash; only
    per-group byte counts are summed up along a source."""
    spark = docs.sparkSession
    size = F.greatest(F.octet_length(F.coalesce(F.col("text"), F.lit(""))), F.lit(1)).cast("long")
    rows = docs.select("doc_id", F.col("source").alias("source"), _key("source").alias("k"), size.alias("size"))
    totals = rows.groupBy("k").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    kind = dict(docs.dtypes)
    if not totals:
        return spark.createDataFrame([], f"doc_id {kind['doc_id']}, source {kind['source']}, block long, epoch long, slot long, offset long")
    if weights is None:
        target = {r["k"]: r["bytes"] ** TEMPERATURE for r in totals}
    else:
        named = {"null" if s is None else f"={s}": w for s, w in weights.items()}
        target = {r["k"]: named.get(r["k"], 0) for r in totals}
        if min(target.values()) <= 0:
            raise ValueError("each source needs a weight above 0: " + ", ".join(sorted(k for k, w in target.items() if w <= 0)))
    slots, period = whole_weights(target, period)
    plan = schedule(slots, period)
    blocks = {r["k"]: -(-r["bytes"] // block_bytes) for r in totals}
    length = max(-(-blocks[k] * period // slots[k]) for k in slots)
    had = {k: length // period * slots[k] + sum(t < length % period for t in plan[k]) for k in slots}
    length = max([length, *(((blocks[k] - 1) // slots[k]) * period + plan[k][(blocks[k] - 1) % slots[k]] + 1 for k in slots)])
    had = {k: length // period * slots[k] + sum(t < length % period for t in plan[k]) for k in slots}
    table = spark.createDataFrame([(k, slots[k], blocks[k], had[k], plan[k]) for k in sorted(slots)], "k string, a long, blocks long, had long, plan array<int>")

    groups = max(16, sum(r["n"] for r in totals) // GROUP_ROWS)
    hashed = rows.withColumn("h", F.xxhash64("doc_id", F.lit("mix"))).withColumn("g", F.pmod("h", F.lit(groups)))
    within = Window.partitionBy("k", "g").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hashed.withColumn("upto", F.sum("size").over(within))
    sums = hashed.groupBy("k", "g").agg(F.sum("size").alias("bytes"))
    along = Window.partitionBy("k").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("k", "g", (F.sum("bytes").over(along) - F.col("bytes")).alias("base"))
    at = ranked.join(sums, ["k", "g"]).withColumn("at", F.col("base") + F.col("upto") - F.col("size"))
    dealt = at.join(F.broadcast(table), "k").withColumn("block", F.floor(F.col("at") / block_bytes))  # one row a source, plan entries sum to the period
    turns = dealt.select("doc_id", "source", "block", (F.col("at") % block_bytes).alias("offset"), "a", "blocks", "plan", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("had") - 1 - F.col("block")) / F.col("blocks")))).alias("epoch"))
    turn = F.col("block") + F.col("epoch") * F.col("blocks")
    slot = F.floor(turn / F.col("a")) * period + F.get("plan", (turn % F.col("a")).cast("int"))
    return turns.select("doc_id", "source", "block", "epoch", slot.cast("long").alias("slot"), "offset")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The mixed stream itself: every column of docs with epoch, slot and offset, one row for each turn of a document.

    Needs distinct, non-null ids."""
    placed = place(docs, weights, block_bytes).select(F.col("doc_id").alias("_id"), "epoch", "slot", "offset")
    return docs.join(placed, F.col("doc_id") == F.col("_id")).drop("_id")
