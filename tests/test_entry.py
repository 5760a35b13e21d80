"""Every registered graph query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from graphweft.plans import fixture
from graphweft.plans import queries as core

DIR = "/root/testdata/sf0.001"


def normal(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return tuple(map(normal, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in fixture.TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.skipif(not Path(DIR).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, con, name):
    df = core.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.sql(core.oracle_sql()[name])
    at = [found.columns.index(c) for c in columns]
    assert len(found.columns) == len(columns)
    assert got == sorted((tuple(normal(r[i]) for i in at) for r in found.fetchall()), key=repr)
