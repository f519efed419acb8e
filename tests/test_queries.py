"""Every registered query against its SQL twin in DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from feedlake.queries import articles, assets, discovery, runs, stores, streams, texts

duckdb = pytest.importorskip("duckdb")

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_every_query_of_the_library_has_an_oracle():
    own = {name for module in (discovery, texts, articles, assets, runs, streams, stores) for name in module.QUERIES}
    assert own <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["page_id", "safe_name", "route", "note_text"] and rows.count() > 0


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, SF_DIR)
    names = sorted(found.columns)
    mine = sorted(tuple(map(str, row)) for row in found.select(*names).collect())
    expected = duck.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({entry.oracle_sql()[name]})")
    assert mine == sorted(tuple(map(str, row)) for row in expected.fetchall())
