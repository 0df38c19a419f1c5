"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402
from catalogue import frames, sql  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_of_the_catalogue_has_sql():
    assert set(frames.QUERIES) == set(sql.statements())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    expected = duck.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    got = ordered(df.columns, df.collect())
    assert got == ordered(expected.columns, expected.fetchall())


def test_entry_counts_documents_per_type(spark):
    rows = contract.entry(spark).collect()
    assert {r.type for r in rows} <= {"EMAIL", "PHONE", "CREDIT_DEBIT_NUMBER"} and rows
