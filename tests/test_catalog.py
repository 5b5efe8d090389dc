"""Every registered query of the collection engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from feedloom.plans import catalog, changes, claims, flows, policy, streams  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def rows(frame, columns):
    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(tuple("-" if x is None else str(x) for x in r) for r in values.values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_source_list_has_no_limit(spark):
    found = catalog.QUERIES["source_list"](spark, SF)
    assert "Limit" not in found._jdf.queryExecution().analyzed().toString()
