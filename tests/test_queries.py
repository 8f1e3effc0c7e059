"""Every registered fleet query against its SQL, on the smallest tables."""

import duckdb
import pytest

from fleetlens.plans import fleet_queries, model_queries, text_queries

DATA = "/root/testdata/sf0.001"
TABLES = "events embeddings documents conversations orders".split()
QUERIES = [*fleet_queries.QUERIES, *model_queries.QUERIES, *text_queries.QUERIES]
SLOW = {"met8_tree_baseline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_names_are_unique():
    assert len({q.name for q in QUERIES}) == len(QUERIES)


@pytest.mark.parametrize("query", [q for q in QUERIES if q.name not in SLOW], ids=lambda q: q.name)
def test_query(spark, duck, query):
    df = query.run(spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if query.sql is None:
        assert df.columns
        return
    cur = duck.execute(query.oracle())
    assert [c[0] for c in cur.description] == df.columns
    assert sorted(rows, key=str) == sorted(cur.fetchall(), key=str)
