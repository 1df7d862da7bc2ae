"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from conftest import DATA

from siftstone.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


def plain(rows):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{float(x):.8g}" if isinstance(x, (bool, int, float)) else str(x)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    expected = duck.sql(SQL[name])
    assert columns == sorted(expected.columns)
    picked = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, found.select(*columns).collect())) == plain(duck.sql(f"select {picked} from ({SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
