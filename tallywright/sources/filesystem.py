"""Filesystem inventory as a Python data source: one row for each entry below a root, read in parallel by subtree.

    spark.dataSource.register(FilesystemSource)
    spark.read.format("inventory").option("hashFiles", "true").load("/evidence")

It suits trees of moderate size; tree.take_inventory takes those of any shape.

Options: hashFiles, maxHashBytes, maxDepth, maxEntries (each partition), followLinks, splitDepth (2: folders down to that depth are tasks of their
own). Symbolic links are rows, not followed unless asked; then a folder is only entered where its real path lies outside of
the folders that lead to it and below no other task's. Folders that can't be read give an 'error' row. Files are opened without
changing their access time where the system allows it, else it's put back, and access_mode says which; a file that changed while it was hashed is marked
changed_while_read and has no digest. The path must be mounted on the executors; on a cluster that is a shared mount."""

from __future__ import annotations

import hashlib
import os
import stat as st
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import FILES_READ

CHUNK = 1 << 20


class Subtree(InputPartition):
    def __init__(self, rel: str, deep: bool):
        super().__init__(rel)
        self.rel, self.deep = rel, deep


def opened(path: str) -> tuple[int, bool]:
    """A descriptor, and whether reading leaves the access time alone."""
    quiet = getattr(os, "O_NOATIME", 0)
    try:
        return os.open(path, os.O_RDONLY | quiet), bool(quiet)
    except PermissionError:  # only the owner may ask for it
        return os.open(path, os.O_RDONLY), False


def hash_file(path: str, limit: int | None, before: os.stat_result) -> tuple[str | None, str, str]:
    """Digest, status and access mode; before: the file's state before it was opened."""
    h, done, mode = hashlib.sha256(), 0, "none"
    try:
        if limit is not None and before.st_size > limit:
            return None, "hash_skipped_oversize", "skipped"
        fd, quiet = opened(path)
        with os.fdopen(fd, "rb") as f:
            while chunk := f.read(CHUNK):
                done += len(chunk)
                if limit is not None and done > limit:
                    return None, "hash_skipped_oversize", "skipped"
                h.update(chunk)
            after = os.fstat(f.fileno())
    except OSError:
        return None, "read_error", mode
    if quiet:
        mode = "o_noatime"
    else:
        try:
            os.utime(path, ns=(before.st_atime_ns, before.st_mtime_ns))
            mode = "restored"
        except OSError:
            pass
    if (after.st_size, after.st_mtime_ns) != (before.st_size, before.st_mtime_ns):
        return None, "changed_while_read", mode
    return h.hexdigest(), "ok", mode


def record(path: str, full: str, follow: bool) -> tuple:
    """A row of FILES_READ, without a digest."""
    try:
        s = os.stat(full, follow_symlinks=follow)
    except OSError:
        return (path, None, None, None, None, None, "error", "stat_error", None)
    kind = "symlink" if st.S_ISLNK(s.st_mode) else "dir" if st.S_ISDIR(s.st_mode) else "file" if st.S_ISREG(s.st_mode) else "other"
    return (path, s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_atime_ns, None, kind, "ok", None)


class FilesystemReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        on = lambda k: str(options.get(k.lower(), options.get(k, "false"))).lower() == "true"
        number = lambda k: int(v) if (v := options.get(k.lower(), options.get(k))) else None
        self.hash, self.follow = on("hashFiles"), on("followLinks")
        self.limit, self.depth, self.entries = number("maxHashBytes"), number("maxDepth"), number("maxEntries")
        self.split = number("splitDepth") or 2

    def folders(self, rel: str) -> list[str]:
        """Folders directly below one, in name order; none if it can't be read."""
        try:
            with os.scandir(os.path.join(self.root, rel)) as found:
                return [f"{rel}/{e.name}" if rel else e.name for e in sorted(found, key=lambda e: e.name) if e.is_dir(follow_symlinks=self.follow)]
        except OSError:
            return []

    def partitions(self) -> list[InputPartition]:
        """The root's own entries, then those of each folder down to the split depth, then each folder at it with all below."""
        parts: list[InputPartition] = [Subtree("", False)]
        level, deepest = [""], self.split if self.depth is None else min(self.split, self.depth)
        for depth in range(1, deepest + 1):
            level = [f for rel in level for f in self.folders(rel) if not self.follow or self.leads_out(f)]
            parts += [Subtree(f, depth == deepest) for f in level]
        return parts

    def leads_out(self, rel: str) -> bool:
        """Whether a followed folder is none of those above it and not also met as itself below the root."""
        full, real = os.path.join(os.path.realpath(self.root), rel), os.path.realpath(os.path.join(self.root, rel))
        return real == full or not (full.startswith(real.rstrip("/") + "/") or (real + "/").startswith(os.path.realpath(self.root).rstrip("/") + "/"))

    def read(self, partition: Subtree) -> Iterator[tuple]:
        seen: set[str] = set()
        left = self.entries if self.entries is not None else float("inf")
        todo = [(partition.rel, partition.rel.count("/") + 1 if partition.rel else 0)]
        while todo:
            rel, depth = todo.pop()
            full = os.path.join(self.root, rel) if rel else self.root
            real = os.path.realpath(full)
            if real in seen:
                continue
            seen.add(real)
            try:
                with os.scandir(full) as found:
                    entries = sorted(found, key=lambda e: e.name)
            except OSError:
                yield (rel or ".", None, None, None, None, None, "error", "stat_error", None)
                continue
            inner = []
            for e in entries:
                if left <= 0:
                    return
                left -= 1
                path = f"{rel}/{e.name}" if rel else e.name
                yield self.row(path, os.path.join(full, e.name))
                if partition.deep and e.is_dir(follow_symlinks=self.follow) and (self.depth is None or depth < self.depth) and (not self.follow or self.leads_out(path)):
                    inner.append((path, depth + 1))
            todo += reversed(inner)

    def row(self, path: str, full: str) -> tuple:
        row = record(path, full, self.follow)
        if not self.hash or row[6] != "file":
            return row
        try:
            return (*row[:5], *self.digest(full))
        except OSError:
            return (*row[:5], None, "file", "read_error", None)

    def digest(self, full: str) -> tuple:
        digest, status, mode = hash_file(full, self.limit, os.stat(full, follow_symlinks=self.follow))
        return digest, "file", status, mode


class FilesystemSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return FILES_READ

    def reader(self, schema) -> DataSourceReader:
        return FilesystemReader(dict(self.options))
