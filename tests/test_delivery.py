"""The committing sink: one header, all parts or none, replayed batches once, altered parts seen."""

import csv
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from tallywright.session import ship
from tallywright.sources import delivery

ROWS = [(1, "plain"), (2, 'quote " and, comma'), (3, "line\nbreak"), (4, ""), (5, None), (6, "목록 é"), (7, "plain")]
SCHEMA = "id long, name string"


@pytest.fixture
def sink(spark):
    ship(spark)
    spark.dataSource.register(delivery.Delivery)
    return spark


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], str(r[1])))


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)


@pytest.mark.parametrize("kind", ["csv", "jsonl"])
def test_round_trip_append_and_overwrite(sink, tmp_path, kind):
    folder = str(tmp_path / "out")
    df = sink.createDataFrame(ROWS, SCHEMA).repartition(3)
    write = lambda d, mode: d.write.format("delivery").option("as", kind).mode(mode).save(folder)
    write(df, "append")
    write(df.where("id < 3"), "append")
    got = delivery.delivered(sink, folder, SCHEMA)
    assert rows_of(got) == sorted([*ROWS, *ROWS[:2]], key=lambda r: (r[0], str(r[1])))
    parts = delivery.committed(sink, folder)
    assert parts.agg(F.sum("n_rows")).first()[0] == len(ROWS) + 2 and parts.select("commit").distinct().count() == 2
    write(df.where("id = 6"), "overwrite")
    assert rows_of(delivery.delivered(sink, folder, SCHEMA)) == [ROWS[5]]
    assert len([f for f in tree(folder) if f.startswith("part-")]) == 1 and not any("_staging" in f for f in tree(folder))
    write(df.limit(0), "overwrite")
    assert delivery.delivered(sink, folder, SCHEMA).count() == 0


def test_head_and_parts_are_one_list(sink, tmp_path):
    folder = tmp_path / "out"
    sink.createDataFrame(ROWS, SCHEMA).repartition(4).write.format("delivery").mode("append").save(str(folder))
    data = (folder / "head.csv").read_bytes() + b"".join((folder / f).read_bytes() for f in tree(folder) if f.startswith("part-"))
    assert data.count(b"\xef\xbb\xbf") == 1 and data.startswith(b"\xef\xbb\xbf")
    read = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))
    assert read[0] == ["id", "name"]
    assert sorted(read[1:]) == sorted([str(i), n or ""] for i, n in ROWS)


def test_other_columns_and_forms_are_refused(sink, tmp_path):
    folder = str(tmp_path / "out")
    df = sink.createDataFrame(ROWS, SCHEMA)
    df.write.format("delivery").mode("append").save(folder)
    before = tree(folder)
    for other, kind in ((df.withColumnRenamed("name", "path"), "csv"), (df, "xml")):
        with pytest.raises(Exception, match="columns are|csv or jsonl"):
            other.write.format("delivery").option("as", kind).mode("append").save(folder)
        assert tree(folder) == before


def test_a_failed_job_leaves_nothing(sink, tmp_path):
    folder = str(tmp_path / "out")
    good = sink.createDataFrame(ROWS, SCHEMA)
    good.write.format("delivery").mode("append").save(folder)
    before = tree(folder)
    many = sink.range(4000).repartition(4).select("id", F.when(F.col("id") == 3999, F.raise_error(F.lit("torn"))).otherwise(F.lit("x")).cast("string").alias("name"))
    with pytest.raises(Exception, match="torn"):
        many.write.format("delivery").mode("append").save(folder)
    assert tree(folder) == before
    with pytest.raises(Exception, match="torn"):
        many.write.format("delivery").mode("overwrite").save(folder)
    assert tree(folder) == before and rows_of(delivery.delivered(sink, folder, SCHEMA)) == sorted(ROWS)


def test_parts_without_a_commit_do_not_count(sink, tmp_path):
    folder = tmp_path / "out"
    sink.createDataFrame(ROWS, SCHEMA).coalesce(1).write.format("delivery").mode("append").save(str(folder))
    (folder / "part-b00000000000000000009-000000.csv").write_text('9,"from a driver that was lost"\n')
    assert rows_of(delivery.delivered(sink, str(folder), SCHEMA)) == sorted(ROWS)


def test_stream_batches_are_added_once(sink, tmp_path):
    source, folder, check = tmp_path / "in", str(tmp_path / "out"), tmp_path / "check"
    source.mkdir()

    def run():
        q = sink.readStream.schema(SCHEMA).json(str(source)).writeStream.format("delivery").option("as", "jsonl").option("checkpointLocation", str(check)).trigger(availableNow=True).start(folder)
        q.awaitTermination(120)
        assert q.exception() is None

    for k, some in enumerate((ROWS[:3], ROWS[3:])):
        (source / f"{k}.json").write_text("".join(json.dumps({"id": i, "name": n}) + "\n" for i, n in some))
        run()
    assert rows_of(delivery.delivered(sink, folder, SCHEMA)) == sorted(ROWS)
    before = tree(folder)
    last = max((check / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):  # Spark didn't get to note the last batch: it's made again
        p.unlink(missing_ok=True)
    run()
    assert tree(folder) == before and rows_of(delivery.delivered(sink, folder, SCHEMA)) == sorted(ROWS)


def test_altered_parts(sink, tmp_path):
    from tallywright.sources.filesystem import FilesystemSource

    sink.dataSource.register(FilesystemSource)
    folder = tmp_path / "out"
    for k in range(3):
        sink.createDataFrame([(k, "x")], SCHEMA).coalesce(1).write.format("delivery").mode("append").save(str(folder))
    parts = [f for f in tree(folder) if f.startswith("part-")]
    (folder / parts[0]).write_text("0,y\n")
    (folder / parts[1]).unlink()
    (folder / "part-x.csv").write_text("1")
    files = sink.read.format("inventory").option("hashFiles", "true").load(str(folder)).select(F.col("path").alias("rel"), "sha256")
    files = files.withColumn("rel", F.element_at(F.split("rel", "/"), -1))
    got = {r["name"]: r["status"] for r in delivery.altered(files, delivery.committed(sink, str(folder))).collect()}
    assert got == {parts[0]: "changed", parts[1]: "missing", parts[2]: "ok", "part-x.csv": "extra"}
