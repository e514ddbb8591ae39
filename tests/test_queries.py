"""Every query of the graph engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from graphloom.plans import calls, oracle, queries
from graphloom.scratch import clear

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, SQL = queries.queries() | calls.queries(), oracle.oracle_sql() | calls.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted(repr([r[c] for c in columns]) for r in found.collect())
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert sorted(repr([row[names.index(c)] for c in columns]) for row in result.fetchall()) == got
    clear()
