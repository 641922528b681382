"""Where a path lies: network, synchronised folder, removable or fixed drive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder names of file synchronisers, as path segments: exact, or followed by a space, '-' or '_'. Fixed values.
CLOUD_MARKERS = (
    "onedrive", "google drive", "내 드라이브", "googledrivefs", "dropbox", "icloud", "iclouddrive",
    "box", "mybox", "네이버", "naverworks", "nextcloud", "mega",
)
DRIVE_TYPES = {"remote": "remote_mapped", "removable": "removable", "fixed": "local_fixed"}
#: Territories outside the fixed drives of the place.
VIOLATIONS = ("remote_unc", "cloud_sync", "remote_mapped", "removable")


def territories(items: DataFrame, volumes: DataFrame | None = None) -> DataFrame:
    """items (claimed_path) with territory, marker and violation. volumes (drive, type) is optional; drives without a type are unverified."""
    path = F.btrim(F.trim(F.coalesce("claimed_path", F.lit(""))), F.lit('"'))
    segments = F.split(F.lower(path), r"[\\/]+")
    drive = F.upper(F.regexp_extract(path, "^([A-Za-z]):", 1))
    rows = items.withColumns({"_drive": drive, "_path": path, "marker": F.get(F.flatten(F.transform(segments, lambda s: F.filter(F.array(*map(F.lit, CLOUD_MARKERS)), lambda m: (s == m) | s.startswith(F.concat(m, F.lit(" "))) | s.startswith(F.concat(m, F.lit("-"))) | s.startswith(F.concat(m, F.lit("_")))))), F.lit(0))})
    if volumes is not None:
        rows = rows.join(volumes.select(F.upper(F.substring("drive", 1, 1)).alias("_drive"), F.lower("type").alias("_type")), "_drive", "left")
    else:
        rows = rows.withColumn("_type", F.lit(None).cast("string"))
    by_type = F.lit("local_unverified")
    for kind, name in DRIVE_TYPES.items():
        by_type = F.when(F.col("_type") == kind, F.lit(name)).otherwise(by_type)
    territory = (
        F.when(F.col("_path") == "", F.lit("unknown"))
        .when(F.col("_path").startswith("\\\\") | F.col("_path").startswith("//"), F.lit("remote_unc"))
        .when(F.col("marker").isNotNull(), F.lit("cloud_sync"))
        .when(F.col("_drive") != "", by_type)
        .otherwise(F.lit("unknown"))
    )
    return rows.withColumn("territory", territory).withColumn("violation", F.col("territory").isin(*VIOLATIONS)).drop("_drive", "_path", "_type")


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("territory").agg(F.count("*").alias("items"), F.count_if("violation").alias("violations"))
