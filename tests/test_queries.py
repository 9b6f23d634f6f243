"""Every named query against its SQL on the smallest sample."""

import duckdb
import pytest

from check import TABLES, rows_of
from gateledger.plans.catalog import QUERIES
from gateledger.plans.oracle import SQL

@pytest.fixture(scope="module")
def con(sample):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sample}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sample, con, name):
    df = QUERIES[name](spark, sample)
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())
