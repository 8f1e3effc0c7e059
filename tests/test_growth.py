"""What keeps work in proportion to the input: cells are not spread over rows, short vehicles are one group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.functions.sensors import module_values, pack_modules
from fleetlens.operators import clean, labels, stretches
from fleetlens.operators.quantiles import array_quantiles


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def cells(spark, vehicles=("a", "b"), rows=30, size=5, zero=None):
    rng = random.Random(1)
    data = [(v, i, [0.0 if zero == (v, c) and i % 3 == 0 else rng.choice([1.5, 2.25, -3.5, 7.0]) + i % 4 for c in range(size)]) for v in vehicles for i in range(rows)]
    return data, spark.createDataFrame(data, "vehicle_id string, frame_index int, voltages array<double>").repartition(3)


@pytest.mark.parametrize("stretch", [7, 4096])
@pytest.mark.parametrize("by_place", [False, True])
def test_array_quantiles_of_short_and_long_groups(spark, monkeypatch, stretch, by_place):
    monkeypatch.setattr(stretches, "STRETCH", stretch)
    data, df = cells(spark)
    df = df.where("vehicle_id = 'a' or frame_index < 5")
    got = {(r.vehicle_id, r.cell if by_place else None): r.q for r in array_quantiles(df, "vehicle_id", "voltages", (0.05, 0.5, 0.95), by_place).collect()}
    kept = [r for r in data if r[0] == "a" or r[1] < 5]
    for v in "ab":
        x = np.array([r[2] for r in kept if r[0] == v])
        for c in range(5) if by_place else [None]:
            np.testing.assert_allclose(got[v, c], np.quantile(x if c is None else x[:, c], (0.05, 0.5, 0.95)))
    assert len(got) == (10 if by_place else 2)


def test_cells_without_zeros_are_not_spread(spark):
    _, df = cells(spark)
    out = plan(clean.sanitize(df, "voltages"))
    assert "Generate" not in out and "collect_list" not in out


@pytest.mark.parametrize("stretch", [7, 4096])
@pytest.mark.parametrize("place", [2, 66])
def test_zeros_take_the_median_of_their_cell(spark, monkeypatch, stretch, place):
    monkeypatch.setattr(stretches, "STRETCH", stretch)
    data, df = cells(spark, size=70, zero=("a", place))
    got = {(r.vehicle_id, r.frame_index): r.voltages for r in clean.sanitize(df, "voltages").collect()}
    median = float(np.median([r[2][place] for r in data if r[0] == "a" and r[2][place] != 0]))
    for v, i, x in data:
        assert got[v, i] == [median if y == 0 and (v, c) == ("a", place) else y for c, y in enumerate(x)]


def test_modules_of_a_large_pack_are_one_expression(spark):
    """Written out group by group the generated code of a pack of 92 cells is too long to be compiled."""
    df = spark.createDataFrame([(list(map(float, range(92))), list(map(float, range(34))))], "u array<double>, t array<double>")
    by_cell, by_probe = pack_modules(92, 34)
    out = df.select(module_values(F.col("u"), by_cell, True).alias("v"), module_values(F.col("t"), by_probe, False).alias("t"))
    row = out.first()
    assert row.v == [float(a) for a, _ in by_cell] and row.t == [float(a + w - 1) for a, w in by_probe]
    described = df.select(module_values(F.col("u"), by_cell, True).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert described.count("slice(") == 1


def test_residuals_of_a_short_vehicle_are_one_group(spark):
    """Stretches are no shorter than ``STRETCH`` rows, whatever the span of the mean: no row goes to a second one here."""
    _, df = cells(spark)
    counts = df.groupBy("vehicle_id").agg(F.count("*").cast("int").alias("n"))
    out = labels._residuals(df.withColumnRenamed("voltages", "x"), 3, counts)
    assert out.count() == 60 and f"/ {labels.STRETCH}" in plan(out)
