"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

from conftest import SF_DIR

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


# The optional part has tests of its own.
NAMES = list(entry._own_queries())


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, database, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    found = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    result = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(tuple(str(r[i]) for i in places) for r in result.fetchall())
    assert len(found) == len(expected) > 0
    assert found == expected


def test_workers_get_the_package_once(spark):
    for _ in range(2):
        entry.queries()["teams_dim"](spark, SF_DIR)
    assert sum(f.endswith("/stintbook.zip") for f in spark.sparkContext.listFiles) == 1


def test_flagship(spark):
    assert entry.entry(spark).count() == 50
