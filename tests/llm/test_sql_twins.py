"""The operators that SQL can express give what DuckDB gives on the given tables."""

import duckdb
import pytest

from lithic.llm import catalog


def value(x):
    return float(f"{x:.12g}") if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, small, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    cursor = connection.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    frame = catalog.queries()[name](spark, small)
    assert sorted(frame.columns) == sorted(names)
    found = [tuple(map(value, r)) for r in frame.select(*names).collect()]
    assert sorted(map(repr, found)) == sorted(repr(tuple(map(value, r))) for r in cursor.fetchall())
