"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from strandframe.plans import file_queries, queries  # noqa: F401  the former registers its own

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, sql, name):
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), sql.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    plain = lambda t: sorted(tuple(map(str, r)) for r in t[columns].itertuples(index=False))
    assert plain(got) == plain(want)
    assert {c: got[c].dtype for c in columns} == {c: want[c].dtype for c in columns}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
