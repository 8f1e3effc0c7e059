"""What several passes read is made once."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.sensors import parse_series
from fleetlens.plans import fleet_queries, model_queries

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_item_is_parsed_once(spark):
    df = spark.createDataFrame([("1.5~x~~inf~2",), ("",), (None,)], "t string").repartition(2).select(parse_series(F.col("t")).alias("a"))
    assert plan(df).count("try_cast") == 1
    assert sorted(map(str, (r.a for r in df.collect()))) == ["[0.0]", "[1.5, 0.0, 0.0, 2.0]", "[]"]


@pytest.mark.parametrize("name", ["cln2_normalize", "cln3_quality"])
def test_series_are_made_once(spark, name):
    query = next(q for q in fleet_queries.QUERIES if q.name == name)
    assert "format_string" not in plan(query.run(spark, DATA))


def test_the_model_table_is_read_by_columns(spark):
    table = model_queries._model_table(spark, DATA, {"ins_rins_min"})
    assert "parquet" in plan(table) and "LogicalRDD" not in plan(table)
    assert [c for c in table.columns if c.split("_")[0] in ("sd", "isc", "conn", "samp", "ins")] == ["ins_rins_min"]
