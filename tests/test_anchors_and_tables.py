"""Features at the windows' last rows, bucketed tables, observers in order, and labels of mixed fleets."""

import uuid

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators import features, labels, stretches
from fleetlens.sources import telemetry
from fleetlens.sources.shared import fresh_path


def naive_icc(rows):
    v = np.array(rows)
    out = []
    for a, b in zip(v.T[:-1], v.T[1:]):
        m = (a.mean() + b.mean()) / 2
        variance = (((a - m) ** 2).mean() + ((b - m) ** 2).mean()) / 2
        out.append(1.0 if variance == 0 else ((a - m) * (b - m)).mean() / variance)
    return min(out, default=1.0)


@pytest.mark.parametrize("length", [7, 4096])
def test_window_icc(spark, monkeypatch, length):
    monkeypatch.setattr(stretches, "STRETCH", length)
    rng = np.random.default_rng(4)
    volts = {v: np.round(3.6 + 0.05 * rng.normal(size=(60, n)), 3) for v, n in (("a", 4), ("b", 2), ("c", 1))}
    volts["a"][20:34] = 3.3  # a stretch without any change
    volts["b"][40:50, 1] = volts["b"][40:50, 0]
    df = spark.createDataFrame([(v, i, r.tolist()) for v, x in volts.items() for i, r in enumerate(x)], "vehicle_id string, frame_index int, voltages array<double>")
    ends = [(f"{v}{e}", v, e) for v in volts for e in range(5, 60, 3)]
    got = {r[0]: r[1] for r in features.window_icc(df, spark.createDataFrame(ends, "sample_id string, vehicle_id string, end_frame int"), 6).collect()}
    want = {s: naive_icc(volts[v][e - 5 : e + 1]) for s, v, e in ends}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-8 for s in want)
    assert got["a26"] == 1.0 and got["c5"] == 1.0


def test_nearest_equals_a_full_sort():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 6, 7, 40):
        for scale in (3, 50):  # many equal values and equal distances
            observers, x = rng.integers(0, scale, n).astype(float), rng.integers(-2, scale + 2, 30).astype(float)
            want = np.argsort(np.abs(x[:, None] - observers[None, :]), axis=1, kind="stable")[:, : labels.NEIGHBOURS]
            assert (labels._nearest(x, observers) == want).all()


def test_bucketed_tables_need_no_exchange(spark):
    rows = spark.range(200).select(F.concat(F.lit("V"), F.col("id") % 9).alias("vehicle_id"), F.floor(F.col("id") / 9).cast("int").alias("frame_index"), F.col("id").alias("x"))
    names = [f"t{uuid.uuid4().hex}" for _ in range(2)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        a, b = (telemetry.write_bucketed(rows.withColumnRenamed("x", c), n, 4, path=fresh_path(spark, n)) for n, c in zip(names, "xy"))
        moved = F.col("y") - F.lag("y").over(Window.partitionBy("vehicle_id").orderBy("frame_index"))
        joined = a.join(b, ["vehicle_id", "frame_index"]).withColumn("moved", moved)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 0 and "SortMergeJoin" in plan and "Window" in plan
        assert sorted(r.moved for r in joined.collect() if r.moved is not None) == [9] * 191
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
        for n in names:
            spark.sql(f"drop table if exists {n}")


def test_packs_and_insulation_by_vehicle(spark):
    rng = np.random.default_rng(2)
    rows = []
    for v, cells, probes, given in (("a", 6, 2, True), ("b", 9, 3, False), ("c", 6, 2, None)):
        for i in range(30):
            rows.append((v, i, 1, 20.0, rng.normal(3.6, 0.01, cells).tolist(), [120.0 if (v, i) == ("b", 7) else 30.0] * probes, given if i == 3 else False))
    df = spark.createDataFrame(rows, "vehicle_id string, frame_index int, charge_status int, insulation_resistance double, voltages array<double>, temperatures array<double>, insulation_given boolean")
    modules = {(r[0], r[1]) for r in labels.module_series(df).groupBy("vehicle_id").agg(F.max("module") + 1).collect()}
    assert modules == {("a", 2), ("b", 3), ("c", 2)}
    got = {(r.vehicle_id, r.frame_index): r for r in labels.core_labels(df, rolling=5, raw=True).collect()}
    assert len(got) == 90 and got["b", 7].label_raw_isc == 1
    assert {v: (r.label_raw_ins, r.label_source) for (v, i), r in got.items() if i == 9} == {
        "a": (1, "raw_reconstructed_rules"), "b": (0, "raw_reconstructed_rules_partial_ins"), "c": (0, "raw_reconstructed_rules_partial_ins"),
    }
