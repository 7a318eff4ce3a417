"""Every training-data query with SQL agrees with DuckDB on the smallest driver tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tests.test_oracles import DATA, TABLES, plain
from tidemark.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = queries.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    mine = sorted(str([plain(v) for v in r]) for r in found.select(columns).collect())
    told = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert mine == sorted(str([plain(r[i]) for i in order]) for r in told.fetchall())
    assert mine
