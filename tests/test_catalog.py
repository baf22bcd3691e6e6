"""Each catalog query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from docweft.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, DIR)
    order = sorted(frame.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == order
    rows = lambda found: sorted((tuple(str(x) for x in r) for r in found), key=str)
    got = rows(frame.select(*order).collect())
    assert got == rows(duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in order)} FROM ({catalog.ORACLES[name]})").fetchall())
    assert got


def test_every_query_runs(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLES):
        assert catalog.QUERIES[name](spark, DIR).count() > 0, name
