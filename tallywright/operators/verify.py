"""Verification of claimed items: resolve, compare digests, judge scope. One row an item, with flags that don't exclude each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from ..plans.criteria import Profile, evaluate
from ..schema import VERIFY_STATUSES
from .resolve import exact_and_suffix, fuzzy


def verify(items: DataFrame, files: DataFrame, profile: Profile | None = None, live: DataFrame | None = None, similar: bool = True, hash_sets: DataFrame | None = None) -> DataFrame:
    """ord, claimed_path, digest, matched_path, tier, status, scope_verdict and flags hash_incomparable, no_claimed_hash, missing_now, fuzzy_matched.

    live (path, md5, sha1, sha256, sha512): the files as they are now; digests of other algorithms can only be compared there."""
    tiers = exact_and_suffix(items, files)
    if similar:
        open_ = tiers.where("tier IS NULL AND NOT coalesce(unparsed, false)")
        tiers = tiers.join(fuzzy(open_, files), "rel", "left")
    else:
        tiers = tiers.withColumns({"fuzzy_path": F.lit(None).cast("string"), "ambiguous": F.lit(False)})
    tiers = tiers.withColumns({
        "matched_path": F.coalesce("matched_path", "fuzzy_path"),
        "tier": F.coalesce("tier", F.when(F.col("fuzzy_path").isNotNull(), F.lit("fuzzy"))),
        "unsure": F.coalesce("ambiguous", F.lit(False)) | (F.col("suffix_hits") > 1),
    })
    judged = evaluate(files, profile, hash_sets=hash_sets) if profile is not None else files.withColumn("verdict", F.lit("unknown"))
    records = judged.select(F.col("path").alias("matched_path"), F.col("sha256").alias("held"), F.col("verdict").alias("scope_verdict"))
    rows = tiers.join(records, "matched_path", "left")
    if live is not None:
        now = live.select(F.col("path").alias("matched_path"), F.create_map(*[x for n in digests.LENGTHS for x in (F.lit(n), F.col(n))]).alias("live"), F.lit(True).alias("present"))
        rows = rows.join(now, "matched_path", "left")
    else:
        rows = rows.withColumns({"live": F.lit(None).cast("map<string,string>"), "present": F.lit(None).cast("boolean")})
    algo = F.coalesce("hash_algo", digests.algorithm(F.col("digest")))
    claim = F.lower(F.nullif(F.col("digest"), F.lit("")))
    foreign = claim.isNotNull() & ~algo.eqNullSafe(F.lit("sha256"))
    recomputed = F.lower(F.element_at("live", F.coalesce(algo, F.lit("unknown"))))
    matched = F.col("matched_path").isNotNull() & ~F.coalesce("unparsed", F.lit(False))
    status = (
        F.when(F.coalesce("unparsed", F.lit(False)), F.lit("unparsed_item"))
        .when(F.col("matched_path").isNull(), F.when(F.col("unsure"), F.lit("ambiguous_path")).otherwise(F.lit("not_in_inventory")))
        .when(foreign & recomputed.isNotNull(), F.when(recomputed == claim, F.lit("verified")).otherwise(F.lit("hash_mismatch")))
        .when(foreign | claim.isNull(), F.lit("verified"))
        .when(F.col("held").isNull() | (F.col("held") == ""), F.lit("unverifiable"))
        .when(F.lower("held") != claim, F.lit("hash_mismatch"))
        .otherwise(F.lit("verified"))
    )
    rows = rows.withColumns({
        "before": status,
        "hash_incomparable": F.coalesce(matched & foreign & recomputed.isNull(), F.lit(False)),
        "no_claimed_hash": matched & claim.isNull(),
        "fuzzy_matched": F.coalesce(F.col("tier") == "fuzzy", F.lit(False)),
    })
    gone = F.lit(live is not None) & (F.col("before") == "verified") & F.col("present").isNull()
    moved = (F.col("before") == "verified") & (F.lower(F.element_at("live", "sha256")) != F.lower("held"))
    return rows.select(
        "ord", "claimed_path", "digest", "matched_path", "tier",
        F.when(F.coalesce(moved, F.lit(False)), F.lit("hash_mismatch")).otherwise(F.col("before")).alias("status"),
        F.when(matched, F.col("scope_verdict")).otherwise(F.lit("unknown")).alias("scope_verdict"),
        "hash_incomparable", "no_claimed_hash", gone.alias("missing_now"), "fuzzy_matched",
    )


def summary(results: DataFrame) -> DataFrame:
    """One row: statuses, the flags beside them, and scope verdicts kept apart (excluded counts as scope_unknown)."""
    flags = ("hash_incomparable", "no_claimed_hash", "missing_now", "fuzzy_matched")
    scope = {"scope_in_scope": "in_scope", "scope_in_scope_partial": "in_scope_partial", "scope_borderline": "borderline", "scope_out_of_scope": "out_of_scope", "scope_unverifiable": "unverifiable"}
    return results.agg(
        F.count("*").alias("items"),
        *[F.count_if(F.col("status") == s).alias(s) for s in VERIFY_STATUSES],
        *[F.count_if(f).alias(f) for f in flags],
        *[F.count_if(F.col("scope_verdict") == v).alias(n) for n, v in scope.items()],
        F.count_if(F.col("scope_verdict").isin("unknown", "excluded")).alias("scope_unknown"),
    )
