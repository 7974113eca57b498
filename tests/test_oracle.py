"""Every repository query that SQL expresses gives DuckDB's rows on the smallest tables, if they are there."""

import decimal
import math
import os

import duckdb
import pytest

from codestrata import registry

DATA = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 5) + 0.0 if math.isfinite(value) else str(value)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in table), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    df = registry.queries()[name](spark, DATA)
    expected = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())
