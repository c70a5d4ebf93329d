"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from pixelloom.plans import all_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(all_queries.ORACLES))
def test_against_sql(spark, con, name):
    df = all_queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = con.execute(all_queries.ORACLES[name])
    at = [c[0] for c in result.description]
    assert sorted(at) == names
    wanted = sorted((tuple(plain(r[at.index(c)]) for c in names) for r in result.fetchall()), key=repr)
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(all_queries.QUERIES) - set(all_queries.ORACLES)))
def test_runs(spark, name):
    df = all_queries.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(all_queries.QUERIES) <= set(__spark_entry__.queries())
