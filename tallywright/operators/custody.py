"""Seals, checksum verification, mirrors, disposal lists and inquiries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .needles import contained


def root_hash(sums: DataFrame, key: str) -> DataFrame:
    """key, files, root: sha256 over the digests (rel, digest) of each archive in its path order, component by component.

    The seal is one hash over all digests in a row, so one task must see an archive's digests in order; it streams through them as
    they come from the sort and holds nothing but the hash so far."""
    kind = dict(sums.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, h, began, type_ = None, 0, hashlib.sha256(), False, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], type_), pa.array([n], pa.int64()), pa.array([h.hexdigest()])], ["key", "files", "root"])

        for b in batches:
            type_ = b.column(0).type
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if began and k != at:
                    yield row()
                    n, h = 0, hashlib.sha256()
                at, n, began = k, n + 1, True
                h.update((d or "").encode())
        if began:
            yield row()

    ordered = sums.select(F.col(key).alias("key"), "digest", F.split("rel", "/").alias("_p")).repartition("key").sortWithinPartitions("key", "_p")
    return ordered.select("key", "digest").mapInArrow(run, f"key {kind}, files long, root string").withColumnRenamed("key", key)


def check_sums(sums: DataFrame, files: DataFrame) -> DataFrame:
    """name, verdict (ok, mismatch, missing, unverifiable) of each listed file."""
    held = files.select("name", F.lower("digest").alias("_now"), F.lit(True).alias("_here"))
    verdict = F.when(F.col("_here").isNull(), F.lit("missing")).when(F.col("digest").isNull() | (F.col("digest") == "") | F.col("_now").isNull(), F.lit("unverifiable")).when(F.lower("digest") == F.col("_now"), F.lit("ok")).otherwise(F.lit("mismatch"))
    return sums.join(held, "name", "left").select("name", verdict.alias("verdict"))


def overall(verdicts: DataFrame) -> DataFrame:
    """One row: ok only if every part is; mismatch outweighs missing, missing outweighs unverifiable."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.agg(F.when(n("mismatch") > 0, F.lit("mismatch")).when(n("missing") > 0, F.lit("missing")).when(n("unverifiable") > 0, F.lit("unverifiable")).otherwise(F.lit("ok")).alias("verdict"), F.count("*").alias("parts"))


def rejoined(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """Per archive of parts (archive, part, content): parts, bytes, sha256 of its parts in order, missing (numbers from 1 on that no part has; what is missing
    after the last can't be seen) and verdict against expected (archive, digest): missing_part, unverifiable without a digest to compare with, ok or mismatch.

    A digest of the whole runs through all bytes in order, so an archive is one task's; it holds a part at a time. A repeated number counts as found."""
    kind = dict(parts.dtypes)["archive"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, began, type_ = None, False, None
        n, size, lost, last, h = 0, 0, 0, 0, hashlib.sha256()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": pa.array([at], type_), "parts": [n], "bytes": [size], "sha256": [h.hexdigest()], "missing": [lost]})

        for b in batches:
            type_ = b.column(0).type
            for i in range(len(b)):
                archive, number, content = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_buffer()
                if began and archive != at:
                    yield row()
                    n, size, lost, last, h = 0, 0, 0, 0, hashlib.sha256()
                at, began = archive, True
                lost += max(0, number - last - 1)
                n, size, last = n + 1, size + (content.size if content is not None else 0), number
                h.update(content if content is not None else b"")
        if began:
            yield row()

    ordered = parts.select("archive", F.col("part").cast("long").alias("part"), F.col("content").cast("binary").alias("content")).repartition("archive").sortWithinPartitions("archive", "part")
    whole = ordered.mapInArrow(run, f"archive {kind}, parts long, bytes long, sha256 string, missing long")
    told = expected.select("archive", F.lower(F.nullif("digest", F.lit(""))).alias("_told"))
    verdict = F.when(F.col("missing") > 0, F.lit("missing_part")).when(F.col("_told").isNull(), F.lit("unverifiable")).when(F.col("_told") == F.col("sha256"), F.lit("ok")).otherwise(F.lit("mismatch"))
    return whole.join(told, "archive", "left").select("archive", "parts", "bytes", "sha256", "missing", verdict.alias("verdict"))


def mirror_plan(items: DataFrame, files: DataFrame) -> DataFrame:
    """What to copy: the first item of each rel, with the file's size and how its digest compares with the claim."""
    first = items.withColumn("_k", F.row_number().over(Window.partitionBy("rel").orderBy("ord"))).where("_k = 1").drop("_k")
    held = files.select(F.col("path").alias("rel"), "size", F.lower("sha256").alias("_now"), F.lit(True).alias("_here"))
    claim = F.lower(F.nullif(F.col("digest"), F.lit("")))
    versus = F.when(F.col("_here").isNull(), F.lit("missing")).when(claim.isNull(), F.lit("no_claimed_hash")).when((F.length(claim) != 64) | F.col("_now").isNull(), F.lit("incomparable")).when(claim == F.col("_now"), F.lit("match")).otherwise(F.lit("mismatch"))
    return first.join(held, "rel", "left").select("rel", "ord", "size", versus.alias("hash_vs_claimed"))


#: Results of which the origin can't be told.
NO_ORIGIN = ("ambiguous_path", "not_in_inventory", "unverifiable", "unparsed_item")


def disposal_lists(results: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """section, ord, path, status: the lists to be handed in. An item may be in several sections; ord is null for changes.

    out_of_scope: items that are judged outside the scope. absent_now: items that were there and are gone. origin_unknown: items whose
    origin can't be told. backdated: files that were added with a time before the baseline, from changes (as from diff.diff)."""
    sections = F.array_compact(F.array(
        F.when(F.col("scope_verdict") == "out_of_scope", F.lit("out_of_scope")),
        F.when(F.col("missing_now"), F.lit("absent_now")),
        F.when(F.col("status").isin(*NO_ORIGIN), F.lit("origin_unknown")),
    ))
    listed = results.select(F.explode(sections).alias("section"), "ord", F.col("claimed_path").alias("path"), "status")
    if changes is None:
        return listed
    late = changes.where("change = 'added' AND backdated").select(F.lit("backdated").alias("section"), F.lit(None).cast(dict(results.dtypes)["ord"]).alias("ord"), "path", F.lit("added").alias("status"))
    return listed.unionByName(late)


def numbered_lists(listed: DataFrame) -> DataFrame:
    """Items of disposal_lists() in each section, with no, their number within it, by ord and path."""
    order = ["section", "ord", "path"]
    return numbered(listed, order, ["section"])


def numbered(rows: DataFrame, order: list[str], within: list[str]) -> DataFrame:
    """rows with no, from 1 within each group of the columns within, which lead order. Sorted by range; counts of the ranges are added up,
    so that no task numbers a whole group."""
    shared_folder(rows.sparkSession)  # the checkpoint keeps the ranges the same for both uses
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy(*within, "_part").orderBy(*order)
    local = ranged.withColumn("_no", F.row_number().over(inside))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = local.groupBy(*within, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return local.join(counts, [*within, "_part"]).withColumn("no", F.col("_no") + F.col("_before")).drop("_part", "_no", "_before")


def inquire(results: DataFrame, changes: DataFrame, queries: DataFrame) -> DataFrame:
    """query, source, path: for each query (query), items whose claimed or matched path contains it, in any case; changed paths only for
    queries that no item answers."""
    needles = queries.select(F.col("query").alias("needle"))
    items = results.select(F.concat_ws("\n", "claimed_path", "matched_path").alias("text"), F.lit("item").alias("source"), F.coalesce("matched_path", "claimed_path").alias("path"))
    hits = contained(items, F.col("text"), needles)
    left = needles.distinct().join(hits.select("needle").distinct(), "needle", "left_anti")
    other = changes.where("change <> 'unchanged'").select(F.col("path").alias("text"), F.lit("change").alias("source"), "path")
    return hits.unionByName(contained(other, F.col("text"), left)).select(F.col("needle").alias("query"), "source", "path")


def status_text(scope, status):
    """A short reading of a result."""
    return (
        F.when(status.isin("not_in_inventory", "ambiguous_path", "unparsed_item"), F.lit("origin not established"))
        .when(status == "hash_mismatch", F.lit("content differs"))
        .when(scope.isin("out_of_scope", "excluded"), F.lit("outside the scope"))
        .when(scope.isin("in_scope", "in_scope_partial"), F.lit("within the scope"))
        .otherwise(F.lit("scope not established"))
    )


def petition_items(results: DataFrame) -> DataFrame:
    """no, claimed_path, digest_start, status, scope_verdict: the list of a petition, items outside the scope first, then those that are gone."""
    outside = results.where("scope_verdict = 'out_of_scope'").withColumn("_list", F.lit(1))
    gone = results.where("missing_now").withColumn("_list", F.lit(2))
    both = numbered(outside.unionByName(gone).withColumn("_all", F.lit(1)), ["_all", "_list", "ord", "claimed_path"], ["_all"])
    return both.select("no", "claimed_path", F.substring("digest", 1, 20).alias("digest_start"), "status", "scope_verdict")


def petition_grounds(results: DataFrame, changes: DataFrame | None = None, places: DataFrame | None = None, audit: DataFrame | None = None, noise: DataFrame | None = None) -> DataFrame:
    """ground, value, term: the numbers that a petition rests on; grounds without data are left out.

    places as from boundary.territories, audit and noise as from audit.keyword_audit and audit.overall."""
    none = F.lit(None).cast("string")
    parts = [results.select(F.explode(F.array(F.lit("items"), F.when(F.col("scope_verdict") == "out_of_scope", F.lit("out_of_scope")), F.when(F.col("missing_now"), F.lit("absent_now")))).alias("ground")).where("ground IS NOT NULL").groupBy("ground").agg(F.count("*").cast("double").alias("value")).withColumn("term", none)]
    if changes is not None:
        kinds = F.when(F.col("class").isin("modified_unverifiable", "content_changed"), F.lit("changed")).when(F.col("change") == "removed", F.lit("removed"))
        parts.append(changes.select(kinds.alias("ground")).where("ground IS NOT NULL").groupBy("ground").agg(F.count("*").cast("double").alias("value")).withColumn("term", none))
    if places is not None:
        parts.append(places.agg(F.count_if("violation").cast("double").alias("value")).where("value > 0").select(F.lit("outside_territory").alias("ground"), "value", none.alias("term")))
    if audit is not None and noise is not None:
        parts.append(noise.where("attributed > 0").select(F.lit("noise").alias("ground"), F.col("noise_ratio").alias("value"), none.alias("term")))
        top = audit.where("seized > 0").agg(F.max(F.struct("noise_ratio", "seized", -F.col("ord"), "term")).alias("x")).where("x IS NOT NULL")
        parts.append(top.select(F.lit("worst_keyword").alias("ground"), F.col("x.noise_ratio").alias("value"), F.col("x.term").alias("term")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
