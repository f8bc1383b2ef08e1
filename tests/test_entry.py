"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from kindred import queries as library

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


def sorted_rows(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted_rows(df.select(*columns).collect())
    if name in library.SQL:
        expected = con.sql(library.SQL[name])
        assert sorted(expected.columns) == columns
        assert rows == sorted_rows(expected.project(", ".join(f'"{c}"' for c in columns)).fetchall())
