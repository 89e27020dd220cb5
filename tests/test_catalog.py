"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from chatterscope.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in catalog.ORACLES:
        r = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(dict(zip(names, x, strict=True))[c]) for c in columns) for x in r.fetchall()), key=repr)
        assert got == want
