"""A sink whose parts count all together or not at all: lists and logs as CSV or JSON lines, with the digest of each part.

    spark.dataSource.register(Delivery)
    rows.write.format("delivery").option("as", "csv").mode("append").save("/mnt/case/list")
    events.writeStream.format("delivery").option("as", "jsonl").option("checkpointLocation", ...).start("/mnt/case/log")

Tasks write to a staging folder. When all are done, the driver names their parts and then puts one commit file in place, in one step; what no
commit file lists doesn't exist for a reader. A failed job or task leaves nothing. A micro-batch that is made again finds its commit file and
adds nothing. Tasks that run twice have files of their own, and only that of the one which Spark counts is taken.

CSV parts have no header: head.csv has it, once, behind the byte order mark that spreadsheet programs look for, so that head.csv and the
parts in the order of their names are one file. A null is an empty cell, an empty text is "". Overwriting takes the place of all earlier
commits in the same step. One job writes to a folder at a time, a stream to one of its own; the folder must be a path that the driver and
all executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import csv as pa_csv
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

COMMIT = "commit string, replaces boolean, columns array<string>, parts array<struct<name: string, n_rows: long, bytes: long, sha256: string>>"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    n_rows: int
    bytes: int
    sha256: str


def encoded(batch: pa.RecordBatch, kind: str) -> bytes:
    if kind == "csv":
        out = pa.BufferOutputStream()
        pa_csv.write_csv(batch, out, pa_csv.WriteOptions(include_header=False))
        return out.getvalue().to_pybytes()
    return "".join(json.dumps(row, ensure_ascii=False, default=str) + "\n" for row in batch.to_pylist()).encode()


class _Writer:
    def __init__(self, options: dict, schema, overwrite: bool, staging: str):
        named = {k.lower(): v for k, v in options.items()}
        self.kind = named.get("as", "csv")
        if self.kind not in ("csv", "jsonl"):
            raise ValueError(f"as: csv or jsonl, not {self.kind}")
        self.folder, self.columns, self.overwrite = named["path"], list(schema.fieldNames()), overwrite
        self.staging = os.path.join(self.folder, "_staging", staging)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, digest, rows, size = TaskContext.get(), hashlib.sha256(), 0, 0
        os.makedirs(self.staging, exist_ok=True)
        path = os.path.join(self.staging, uuid.uuid4().hex)
        try:
            with open(path, "wb") as f:
                for batch in iterator:
                    data = encoded(batch, self.kind)
                    f.write(data)
                    digest.update(data)
                    rows, size = rows + batch.num_rows, size + len(data)
                f.flush()
                os.fsync(f.fileno())
        except BaseException:
            Path(path).unlink(missing_ok=True)
            raise
        return Written(task.partitionId(), os.path.basename(path), rows, size, digest.hexdigest())

    def clear(self) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
        try:
            os.rmdir(os.path.dirname(self.staging))
        except OSError:
            pass  # another job's files are there, or there was none

    def finish(self, messages: list[Written | None], commit: str) -> None:
        log = Path(self.folder, "_commits")
        log.mkdir(parents=True, exist_ok=True)
        mark = log / f"{commit}.json"
        if not mark.exists():
            earlier = sorted(log.glob("*.json"))
            if earlier and not self.overwrite and (had := json.loads(earlier[-1].read_text(encoding="utf-8"))["columns"]) != self.columns:
                self.clear()
                raise ValueError(f"the folder's columns are {had}, not {self.columns}")
            parts = []
            for k, m in enumerate(sorted((m for m in messages if m is not None and m.n_rows), key=lambda m: m.partition)):
                name = f"part-{commit}-{k:06d}.{self.kind}"
                os.replace(os.path.join(self.staging, m.file), os.path.join(self.folder, name))
                parts.append({"name": name, "n_rows": m.n_rows, "bytes": m.bytes, "sha256": m.sha256})
            if self.kind == "csv":
                names = pa.RecordBatch.from_arrays([pa.array([c]) for c in self.columns], [f"c{k}" for k in range(len(self.columns))])
                self._place(Path(self.folder, "head.csv"), b"\xef\xbb\xbf" + encoded(names, "csv"))
            self._place(mark, json.dumps({"commit": commit, "replaces": self.overwrite, "columns": self.columns, "parts": parts}, ensure_ascii=False).encode())
            if self.overwrite:
                for old in earlier:
                    for part in json.loads(old.read_text(encoding="utf-8"))["parts"]:
                        Path(self.folder, part["name"]).unlink(missing_ok=True)
                    old.unlink()
        self.clear()

    @staticmethod
    def _place(path: Path, data: bytes) -> None:
        draft = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
        with open(draft, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, path)


class DeliveryWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.finish(messages, f"b{time.time_ns():020d}")

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()


class DeliveryStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.finish(messages, f"s{batchId:020d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.clear()


class Delivery(DataSource):
    """The sink; see the module."""

    @classmethod
    def name(cls) -> str:
        return "delivery"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DeliveryWriter(dict(self.options), schema, overwrite, uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return DeliveryStreamWriter(dict(self.options), schema, False, "stream")  # what commits is another writer than what the tasks have


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """commit, name, n_rows, bytes, sha256 of each part that counts."""
    log = spark.read.schema(COMMIT).json(f"{folder}/_commits")
    last = log.where("replaces").agg(F.max("commit").alias("_from"))  # one row
    kept = log.join(last, F.col("_from").isNull() | (F.col("commit") >= F.col("_from")))
    return kept.select("commit", F.explode("parts").alias("p")).select("commit", "p.*")


def mounted(folder: str) -> str:
    """The path of a folder given as a path or file URI; other stores aren't mounted."""
    at = urlsplit(folder)
    if at.scheme not in ("", "file"):
        raise ValueError(f"not a mounted folder: {folder}")
    return unquote(at.path)


def delivered(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """The rows of all parts that count, as the given schema. Names of parts, one for each task that wrote, pass through the driver, as with any table's files."""
    names = sorted(r["name"] for r in committed(spark, folder).select("name").collect())
    if not names:
        return spark.createDataFrame([], schema)
    at = [f"{folder}/{n}" for n in names]
    if names[0].endswith(".jsonl"):
        return spark.read.schema(schema).json(at)
    return spark.read.schema(schema).csv(at, multiLine=True, escape='"', nullValue="\x00", emptyValue="")  # so that an empty cell and "" stay apart


def altered(files: DataFrame, parts: DataFrame) -> DataFrame:
    """name, status (ok, changed, missing, extra) of parts against files (rel, sha256) found in the folder, as the inventory source gives them."""
    seen = files.where(F.col("rel").startswith("part-")).select(F.col("rel").alias("name"), F.col("sha256").alias("now"), F.lit(True).alias("_seen"))
    status = F.when(F.col("_seen").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("now") == F.col("sha256"), "ok").otherwise("changed")
    return parts.select("name", "sha256").join(seen, "name", "full").select("name", status.alias("status"))
