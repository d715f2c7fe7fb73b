"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import pathlib
from collections import Counter

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")

FOLDER = pathlib.Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(contract._graph_queries()) == set(contract._graph_sql())
    assert set(contract._stored_queries()) == set(contract._stored_sql())


@pytest.mark.parametrize("name", sorted(contract._graph_queries() | contract._stored_queries()))
def test_query_matches_sql(spark, con, name):
    got = contract.queries()[name](spark, str(FOLDER))
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = Counter(cursor.fetchall())
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == want


def test_entry(spark):
    row = contract.entry(spark).collect()
    assert [tuple(r) for r in row] == [(36917, 12305)]
