"""Every registered query with SQL gives the same rows on DuckDB; the rest run and return rows."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, canon  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 6 and "mean_compactness" in df.columns


def test_sql_names_are_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pipelines_return_every_test_row(spark, sf):
    queries = entry.queries()
    out = queries["pipeline_ensemble"](spark, sf).toPandas()
    assert list(out.columns) == ["Id", "change_type"] and out.Id.is_unique and len(out) == 273
    assert set(out.change_type) <= set(range(6))
    scored = queries["pipeline_boosting"](spark, sf).toPandas().set_index("split")
    assert scored.loc["test", "macro_f1"] > 0.5
