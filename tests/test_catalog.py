"""Every query with SQL gives what the SQL gives; every other one runs."""

import glob
import os

import duckdb
import pytest

from lectern.plans import catalog, catalog_more, catalog_small, catalog_stitch, catalog_tables  # noqa: F401


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, sql, name):
    got = catalog.queries()[name](spark, sf_dir).collect()
    if name not in catalog.oracle_sql():
        assert got
        return
    want = sql.sql(catalog.oracle_sql()[name])
    order = sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(got[0].asDict()) == order
    rows = sorted(repr([r[i] for i in at]) for r in want.fetchall())
    assert sorted(repr([r[c] for c in order]) for r in got) == rows
