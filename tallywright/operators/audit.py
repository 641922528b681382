"""Keyword noise: how many of the items that a keyword brought in are out of scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def attributions(results: DataFrame, terms: list[str]) -> DataFrame:
    """results (claimed_path, status, scope_verdict) with the array of terms that their claimed file name contains, in any case."""
    name = F.lower(paths.basename(F.translate(F.coalesce("claimed_path", F.lit("")), "\\", "/")))
    return results.withColumn("terms", F.filter(F.array(*map(F.lit, terms)), lambda t: name.contains(F.lower(t))))


def keyword_audit(results: DataFrame, terms: list[str]) -> DataFrame:
    """One row a term, zero hits included, busiest first: seized, in_scope, out_of_scope, unverifiable, missing, noise_ratio.

    Out of scope, excluded and borderline items are noise."""
    per = attributions(results, terms).select(F.explode("terms").alias("term"), "status", "scope_verdict")
    noise, lost = F.col("scope_verdict").isin("out_of_scope", "excluded", "borderline"), F.col("status").isin("not_in_inventory", "ambiguous_path", "unparsed_item")
    counted = per.groupBy("term").agg(
        F.count("*").alias("seized"),
        F.count_if(~lost & F.col("scope_verdict").isin("in_scope", "in_scope_partial")).alias("in_scope"),
        F.count_if(~lost & noise).alias("out_of_scope"),
        F.count_if(~lost & F.col("scope_verdict").isin("unverifiable", "unknown")).alias("unverifiable"),
        F.count_if(lost).alias("missing"),
    )
    every = results.sparkSession.createDataFrame([(i, t) for i, t in enumerate(terms)], "ord int, term string")
    whole = every.join(counted, "term", "left").na.fill(0)
    return whole.withColumn("noise_ratio", F.coalesce(F.round(F.try_divide("out_of_scope", "seized"), 4), F.lit(0.0))).orderBy(F.desc("seized"), "ord")


def overall(results: DataFrame, terms: list[str]) -> DataFrame:
    """One row: noise over attributions (items of several terms count for each) and items of no term."""
    held = attributions(results, terms)
    a = keyword_audit(results, terms).agg(F.sum("seized").alias("attributed"), F.sum("out_of_scope").alias("noise"))
    b = held.agg(F.count("*").alias("items"), F.count_if(F.size("terms") == 0).alias("unattributed"))
    return a.crossJoin(b).withColumn("noise_ratio", F.coalesce(F.round(F.try_divide("noise", "attributed"), 4), F.lit(0.0)))  # one row each


def worst(audit: DataFrame) -> DataFrame:
    return audit.where("seized > 0").agg(F.max_by("term", F.struct("noise_ratio", "seized", -F.col("ord"))).alias("term"), F.max("noise_ratio").alias("noise_ratio"))
