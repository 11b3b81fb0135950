"""Every registered query against its SQL in DuckDB: columns, types and the multiset of rows."""

import os
from collections import Counter

import duckdb
import pytest

from given import SF
from settlespark.plans.registry import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
# Checks whose planted violations must be found, so that agreement is never about nothing.
EMPTY_ALLOWED: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    df = QUERIES[key](spark, SF)
    result = duck.execute(SQL[key])
    names = [c[0] for c in result.description]
    kinds = dict(zip(names, (str(c[1]) for c in result.description)))
    assert sorted(df.columns) == sorted(names)
    for name, kind in df.dtypes:
        assert TYPES[kind] == kinds[name], name
    ours = Counter(tuple(row[n] for n in names) for row in df.collect())
    theirs = Counter(result.fetchall())
    assert ours == theirs
    assert ours or key in EMPTY_ALLOWED
