"""Which of many needles a row's text contains, by an index of grams instead of every needle against every row.

A text that contains a needle has all its grams (of three characters; shorter needles are their own), so it has the needle's rarest one, on which they meet. A needle
of which a gram occurs nowhere is out at once. Every pair meets on one gram only, and so comes out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    several = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(several)).otherwise(F.array().cast("array<string>"))


def contained(rows: DataFrame, text: Column, needles: DataFrame) -> DataFrame:
    """rows with needle, once for each of the distinct needles that their text contains, in any case. A null text contains nothing, an empty needle is in every other."""
    asked = needles.select("needle").where("needle IS NOT NULL").distinct().withColumn("_low", F.lower("needle"))
    short = {r[0] for r in asked.select(F.least(F.length("_low"), F.lit(GRAM))).distinct().collect()}  # 0 to 3
    held = rows.withColumn("_text", F.lower(text)).where("_text IS NOT NULL")
    out = held.join(F.broadcast(asked.where("_low = ''")), F.lit(True))  # one row, or none
    if short - {0}:
        hay = held.withColumn("_gram", F.explode(F.concat(*[_grams(F.col("_text"), n) for n in sorted(short - {0})])))
        own = F.when(F.length("_low") >= GRAM, _grams(F.col("_low"), GRAM)).otherwise(F.array("_low"))
        grams = asked.where("_low <> ''").select("needle", "_low", F.explode(own).alias("_gram"))
        often = hay.select("_gram").join(grams.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
        rarest = grams.join(often, "_gram", "left").groupBy("needle", "_low").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_k"))
        keyed = rarest.where("_k.n > 0").select("needle", "_low", F.col("_k._gram").alias("_gram"))
        out = out.unionByName(hay.join(keyed, "_gram").where(F.contains("_text", "_low")).drop("_gram"))
    return out.drop("_text", "_low")
