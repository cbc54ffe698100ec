"""Every registered memory query against its SQL in DuckDB, on the small tables."""

import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from memloom import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return (round(v, 6) if math.isfinite(v) else str(v)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    rows = sorted((tuple(plain(v) for v in r) for r in got.collect()), key=repr)
    if name not in queries.SQL:
        assert got.columns
        return
    cursor = duck.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    at = [columns.index(c) for c in got.columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
