"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tankline.plans import QUERIES, oracles

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracles()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("NestedLoop", "CartesianProduct", "Python", "InPandas"):
        assert operator not in plan
    result = duck.execute(entry.oracle_sql()[name])
    types = {c[0]: str(c[1]) for c in result.description}
    names = list(types)
    want = result.fetchall()
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    columns = sorted(names)
    got = sorted(repr([row[c] for c in columns]) for row in df.collect())
    assert len(got) > 0
    assert got == sorted(repr([row[names.index(c)] for c in columns]) for row in want)
