"""Every registered query against its check text in DuckDB, at the smallest scale."""

import duckdb
import pytest

from weftline.plans.all_queries import CHECKS, QUERIES
from weftline.plans.bindings import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    result = oracle.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(names)
    want = rows_of(names, result.fetchall())
    assert want, "the check text finds nothing"
    assert rows_of(got.columns, got.collect()) == want
