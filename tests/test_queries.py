"""Every query of the engine's own operators against its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from quern.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = duck.execute(catalogue.ORACLES[name])
    found = [d[0] for d in theirs.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=repr)
    assert sorted((tuple(r) for r in ours.select(*columns).collect()), key=repr) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
