"""Every query with SQL gives DuckDB's rows on the small tables."""

import os

import duckdb
import pytest

from tabulon import queries as Q

DIR = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{DIR}/{n}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_rows(spark, con, name):
    df = Q.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({Q.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())
