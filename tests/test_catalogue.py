"""Every registered query with SQL, held against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lodestrata.plans import catalogue


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    def cell(x):
        if pd.isna(x):
            return None
        return round(float(x), 7) if isinstance(x, float) or type(x).__name__ in ("Decimal", "float64") else int(x) if hasattr(x, "__int__") and not isinstance(x, str) else str(x)

    return sorted((tuple(cell(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, small, con, name):
    got, want = catalogue.QUERIES[name](spark, small).toPandas(), con.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got[columns]) == rows(want[columns])


def test_queries_without_sql_run(spark, small):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.SQL)):
        assert catalogue.QUERIES[name](spark, small).count() > 0, name


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
