"""Every checked query against its SQL, run by DuckDB on the same files."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from newsloom.registry import oracles, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{os.path.join(sf_dir, name)}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def ordered(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(row[i]) for i in order) for row in data]
    return [columns[i] for i in order], sorted(table, key=lambda row: [str(v) for v in row])


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())
    assert set(queries.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_matches_sql(name, spark, sf_dir, duck):
    result = contract.queries()[name](spark, sf_dir)
    cursor = duck.execute(contract.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = ordered([d[0] for d in cursor.description], cursor.fetchall())
    assert ordered(result.columns, [tuple(r) for r in result.collect()]) == expected
    assert {f.name: TYPES[f.dataType.simpleString()] for f in result.schema} == kinds


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["week", "new_kicker", "n", "percentage"]
    assert all(isinstance(r["week"], dt.date) for r in result.collect())
