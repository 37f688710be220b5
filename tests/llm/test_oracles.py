"""Training-data queries with SQL give the rows that DuckDB gives for it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quarry.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = registry.QUERIES[name](spark, SF)
    want = c.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    pick = lambda columns, row: repr([row[i] for i in sorted(range(len(columns)), key=lambda i: columns[i])])
    assert sorted(pick(got.columns, tuple(r)) for r in got.collect()) == sorted(pick(want.columns, r) for r in want.fetchall())
