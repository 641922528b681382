"""Digests: which algorithm a claim is of, whether it is well formed, and digests of bytes by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of each algorithm's digest. Fixed values.
LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128}


def algorithm(digest: Column) -> Column:
    """By length; 'unknown' for other lengths, NULL without a digest."""
    out = F.when(digest.isNull() | (digest == ""), F.lit(None).cast("string"))
    for name, n in LENGTHS.items():
        out = out.when(F.length(digest) == n, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def well_formed(digest: Column, name: str) -> Column:
    return digest.rlike(f"^[0-9a-fA-F]{{{LENGTHS[name]}}}$")


def digest(content: Column, name: Column) -> Column:
    return F.when(name == "md5", F.md5(content)).when(name == "sha1", F.sha1(content)).when(name == "sha256", F.sha2(content, 256)).when(name == "sha512", F.sha2(content, 512))


def number(text: Column) -> Column:
    """Hexadecimal (0x...) or decimal literal as long; NULL for anything else, leading-zero decimals included."""
    t = F.trim(text)
    return F.when(F.lower(t).rlike("^0x[0-9a-f]+$"), F.conv(F.substring(t, 3, 30), 16, 10).try_cast("long")).when(t.rlike("^(0+|-?[1-9][0-9]*)$"), t.try_cast("long"))
