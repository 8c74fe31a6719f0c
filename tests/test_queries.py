"""Every registered archive query against its SQL in DuckDB; those without SQL must give rows."""

import os

import duckdb
import pytest

from palimpsest.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    found = con.sql(f"SELECT * FROM ({registry.ORACLE_SQL[name]})")
    assert sorted(found.columns) == columns
    want = sorted(repr(tuple(map(plain, r))) for r in found.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got == want
