"""The queries with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from fleetlens.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    assert df.columns == [c[0] for c in cur.description]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, cur.fetchall()))


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
