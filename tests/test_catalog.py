"""Every query with SQL beside it gives the same rows as DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from lodestrand import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            db.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return db


def plain(value):
    return str(round(value, 5)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_rows(name, spark, duck):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name in catalog.ORACLE_SQL:
        found = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    else:
        assert rows


def test_flagship_has_sql():
    assert catalog.FLAGSHIP in catalog.QUERIES and catalog.FLAGSHIP in catalog.ORACLE_SQL
