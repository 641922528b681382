"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

from tallywright import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, float):
        return f"{x:.6f}"
    return x.isoformat() if isinstance(x, dt.datetime) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR)
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() > 0


def test_similar_addresses_resolve(spark):
    """A misread address finds its own page, or says that others are as near."""
    got = queries.QUERIES["resolve_similar"](spark, DIR).collect()
    assert len(got) == 50
    misread = str.maketrans("oil", "01|")
    assert all(r["ambiguous"] or r["fuzzy_path"].translate(misread) == r["rel"] for r in got) and all(r["best"] == 1.0 for r in got)
