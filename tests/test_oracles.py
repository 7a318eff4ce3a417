"""Every engine query with SQL agrees with DuckDB on the smallest driver tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tidemark.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or not isinstance(value, int | float):
        return str(value)
    return f"{float(value):.9g}"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    mine = sorted(str([plain(v) for v in r]) for r in found.select(columns).collect())
    told = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(str([plain(r[i]) for i in order]) for r in told.fetchall())
    assert mine == theirs
    assert mine or name == "repeated_line_runs"


def test_entry_runs(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert 0 < len(rows) <= 12
    assert [r["place"] for r in sorted(rows, key=lambda r: r["place"])] == list(range(1, len(rows) + 1))
