"""A folder as a stream of snapshots: each micro-batch is one whole pass over the tree.

    spark.dataSource.register(TreeStream)
    spark.readStream.format("tree").load("/evidence")

Rows are those of watch.SNAPSHOT, and one without a path for each pass. A pass is numbered by the time at which it was asked for, in milliseconds, so that numbers go on ascending
after a restart. A batch that is made again looks at the tree again: what it then finds is what the pass saw. Options: splitDepth, maxDepth, as
for the inventory source; links aren't followed, and folders that can't be read count as empty, as do those that go while they are read."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .filesystem import FilesystemReader, Subtree

SNAPSHOT = "pass long, path string, size long, mtime_ns long, kind string"


class Pass(InputPartition):
    def __init__(self, number: int, part: Subtree):
        super().__init__((number, part.rel))
        self.number, self.part = number, part


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.tree = FilesystemReader({k: v for k, v in options.items() if k.lower() in ("path", "splitdepth", "maxdepth")})

    def initialOffset(self) -> dict:
        return {"pass": 0}

    def latestOffset(self) -> dict:
        return {"pass": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Pass(end["pass"], p) for p in self.tree.partitions()]

    def read(self, partition: Pass) -> Iterator[tuple]:
        if not partition.part.rel:
            yield (partition.number, None, None, None, None)  # a pass over an empty folder is one, too
        for path, size, mtime_ns, *_, kind, _, _ in self.tree.read(partition.part):
            if kind != "error":
                yield (partition.number, path, size, mtime_ns, kind)

    def commit(self, end: dict) -> None:
        """Nothing is kept between passes."""


class TreeStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SNAPSHOT

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStreamReader(dict(self.options))
