"""Registered queries against DuckDB over the same tables."""

import os

import duckdb
import pytest

from vellum.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).to_numpy().tolist()
    return columns, sorted((tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert plain(catalog.queries()[name](spark, SF).toPandas()) == plain(duck.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
