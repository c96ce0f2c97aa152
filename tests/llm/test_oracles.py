"""Queries of the training-data operators that have an oracle."""

import duckdb
import pytest
from pyspark.sql import functions as F  # noqa: F401

from lodestrata.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from read_parquet('{data}/{table}.parquet')")
    df = queries.QUERIES[name](spark, data)
    want = con.sql(oracles.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    plain = lambda x: round(x, 6) if isinstance(x, float) else str(x)
    a = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    b = sorted(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert a == b
