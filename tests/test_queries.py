"""Every registered query that has a SQL twin, against DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from filingloom.plans import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=repr)
    cur = duck.execute(queries.ORACLE_SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    want = sorted(([plain(r[have.index(c)]) for c in names] for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == spark.read.parquet(f"{SF}/supplier.parquet").count() and set(entry.oracle_sql()) <= set(entry.queries())
