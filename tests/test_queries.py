"""Every ledger query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tallyspark import queries, queries_damage, queries_files

SF = "/root/testdata/sf0.001"
SQL = {**queries.oracle_sql(), **queries_files.oracle_sql(), **queries_damage.oracle_sql()}
QUERIES = {**queries.queries(), **queries_files.queries(), **queries_damage.queries()}


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in ("lineitem", "supplier", "part", "orders", "customer"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value if isinstance(value, int) else None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    frame, sql = QUERIES[name](spark, SF), tables.sql(SQL[name])
    order = sorted(frame.columns)
    assert order == sorted(sql.columns)
    key = lambda row: tuple(str(x) for x in row)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=key)
    at = [sql.columns.index(c) for c in order]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=key)
    assert ours == theirs
    spark.catalog.clearCache()
