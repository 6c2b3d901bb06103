"""Every query that SQL can express gives what DuckDB gives on the same tables."""

import decimal
import math

import duckdb
import pytest

from lithic import catalog
from lithic.views import TABLES


def value(x):
    if isinstance(x, float | decimal.Decimal):
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}") + 0.0
    return x


def rows_of(rows, order):
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, small, duck, name):
    frame = catalog.QUERIES[name](spark, small)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    expected = rows_of(cursor.fetchall(), [names.index(c) for c in sorted(names)])
    assert rows_of(frame.collect(), sorted(names)) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_give_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
