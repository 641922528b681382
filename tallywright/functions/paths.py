"""Path text: normal form, parts, suffixes and prefixes, and the key that folds look-alike characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: Column) -> Column:
    """Trimmed, forward slashes, single, without drive letter and leading slash."""
    p = F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(p, "^[A-Za-z]:(?=/)", ""), "^/+", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """'.' and what follows the last dot of the name, in lower case; '' without a dot."""
    name = F.lower(basename(path))
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffixes(path: Column) -> Column:
    """The path's proper suffixes that begin after a slash: 'a/b/c' gives ['b/c', 'c']."""
    parts = F.split(path, "/")
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def ancestors(path: Column) -> Column:
    """All directories above the path, shortest first: 'a/b/c' gives ['a', 'a/b']."""
    parts = F.split(path, "/")
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def fuzzy_key(path: Column) -> Column:
    """Lower case with letters that scanners confuse with digits folded to those. O-0, i l | -1, s-5, z-2, g q-9."""
    return F.translate(F.lower(F.translate(path, "\\", "/")), "oil|szgq", "01115299")


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as a Java regular expression for the whole text; '*' also crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1 if pattern[i : i + 1] in ("!", "]") else i
            if pattern[i : i + 2] == "!]":
                j = i + 2
            end = pattern.find("]", j)
            if end < 0:
                out.append(r"\[")
                continue
            body = pattern[i:end]
            i = end + 1
            negate = body.startswith("!")
            body = body[negate:].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&").replace("]", r"\]")
            body = "\\" + body if body.startswith("^") else body
            out.append(f"[{'^' if negate else ''}{body}]")
        else:
            out.append("\\" + c if not c.isalnum() and ord(c) < 128 and c not in "_/ " else c)
    return "(?s)^" + "".join(out) + r"\z"
