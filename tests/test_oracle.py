"""Every core query against its SQL twin over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from foliary import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return v.item() if hasattr(v, "item") else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck):
    ours, theirs = queries.queries()[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_runs(name, spark):
    assert queries.queries()[name](spark, DATA).count() >= 0
