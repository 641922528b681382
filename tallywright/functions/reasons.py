"""Change-journal reasons: bit masks and their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bit and name.
REASONS = {
    0x1: "data_overwrite",
    0x2: "data_extend",
    0x4: "data_truncation",
    0x10: "named_data_overwrite",
    0x20: "named_data_extend",
    0x40: "named_data_truncation",
    0x100: "file_create",
    0x200: "file_delete",
    0x400: "ea_change",
    0x800: "security_change",
    0x1000: "rename_old",
    0x2000: "rename_new",
    0x4000: "indexable_change",
    0x8000: "basic_info_change",
    0x10000: "hard_link_change",
    0x20000: "compression_change",
    0x40000: "encryption_change",
    0x80000: "object_id_change",
    0x100000: "reparse_point_change",
    0x200000: "stream_change",
    0x80000000: "close",
}
NOTABLE = ("file_delete", "rename_old", "security_change")
#: Other spellings in exported journals, letters only. Fixed values.
SPELLINGS = {"renameoldname": "rename_old", "renamenewname": "rename_new", "hardlinkchange": "hard_link_change", "eachange": "ea_change", "objectidchange": "object_id_change"}


def names(mask: Column) -> Column:
    """Names of the mask's bits, in bit order."""
    return F.filter(F.array(*[F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in REASONS.items()]), lambda x: x.isNotNull())


def mask(text: Column) -> Column:
    """The mask of names joined by '|', whatever their case and separators; unknown names add nothing."""
    known = {name.replace("_", ""): bit for bit, name in REASONS.items()} | {k: next(b for b, n in REASONS.items() if n == v) for k, v in SPELLINGS.items()}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in (kv[0], kv[1])])
    letters = F.transform(F.split(F.lower(text), "\\|"), lambda x: F.regexp_replace(x, "[^a-z]", ""))
    return F.aggregate(F.array_distinct(letters), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.coalesce(F.element_at(table, x).cast("long"), F.lit(0).cast("long"))))
