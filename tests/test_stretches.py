"""Steps along rows by short stretches against whole vehicles and loops over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import clean, events, labels, stretches

ROWS = 300


def rows_of(result):
    return sorted(map(str, result.collect()))


def frames(spark, seed=3):
    """Two vehicles and one of a single row; resistances on a coarse grid, so steps of exactly the limit occur."""
    rng, out = random.Random(seed), []
    for vehicle, n in (("long", ROWS), ("short", 20), ("one", 1)):
        r, t = 200.0, 1000
        for i in range(n):
            r = rng.choice([r, r, r + 1, r - 1, r + 2, rng.choice([0.0, 40.0, 42.0, 1000.0])])
            t += rng.choice([10, 10, 10, 50])
            volts = rng.choice([[3.5, 3.6], [3.5, 3.6], [3.5], [], None, [1.0, 2.0, 3.0]])
            out.append((vehicle, i, t, rng.choice([1, 2, 3, 3, 4]), r, volts, None if rng.random() < 0.6 else str(t), rng.randrange(2), int(rng.random() < 0.3)))
    return spark.createDataFrame(out, "vehicle_id string, frame_index int, timestamp long, charge_status int, insulation_resistance double, voltages array<double>, time string, a int, b int")


def merged(df):
    return events._merged(df.select("vehicle_id", "frame_index", "a", "b"), {"x": "a", "y": "b"}, 2)


STEPS = {
    "segments": lambda df: labels.segments(df.select("vehicle_id", "frame_index", "timestamp")),
    "epoch": lambda df: clean.epoch_seconds(df.select("vehicle_id", "frame_index", "time"), "time", "seconds"),
    "normalize": lambda df: clean.normalize_sensors(df.select("vehicle_id", "frame_index", "voltages"), "voltages", "ok"),
    "steps": lambda df: labels.steps(df.withColumn("voltages", F.array(F.col("insulation_resistance")))),
    "insulation": lambda df: labels.insulation(df, 0.002),
    "merge": merged,
    "events": lambda df: events.extract_events(df.select("vehicle_id", "frame_index", F.lit("sd").alias("fault_type"), F.col("b").alias("label"))),
}


@pytest.mark.parametrize("name", STEPS)
@pytest.mark.parametrize("length", [1, 7])
def test_short_stretches_equal_whole_vehicles(spark, monkeypatch, name, length):
    df = frames(spark)
    whole = rows_of(STEPS[name](df))
    monkeypatch.setattr(stretches, "STRETCH", length)
    assert rows_of(STEPS[name](df)) == whole


def walk(rows, tolerance):
    """The rule as a walk over one vehicle's rows."""
    n, r = len(rows), [x.insulation_resistance for x in rows]
    label = []
    for i, x in enumerate(rows):
        s = x.charge_status
        near_charging = i >= 2 and i + 2 <= n and any(rows[j].charge_status in (1, 2) for j in (i - 1, i + 1))
        label.append(int(r[i] < 41) if s in (1, 2) else int(r[i] < 205) if not (near_charging and r[i] > 41) else 0)
    limit, out, passes = tolerance * (max(r) - min(r)), list(label), 0
    for i in range(n):
        step = abs(r[i] - r[i - 1]) if i else None
        if i and step == limit:
            passes = 1 if label[i] else passes
            continue
        got = bool(i and step < limit and passes)
        out[i] = int(label[i] or got)
        passes = int(label[i] and not got)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_insulation_equals_the_walk(spark, monkeypatch, seed):
    monkeypatch.setattr(stretches, "STRETCH", 11)
    df = frames(spark, seed)
    by = {}
    for x in df.orderBy("vehicle_id", "frame_index").collect():
        by.setdefault(x.vehicle_id, []).append(x)
    got = {(x.vehicle_id, x.frame_index): x.label for x in labels.insulation(df, 0.001).collect()}
    assert got == {(v, x.frame_index): y for v, rows in by.items() for x, y in zip(rows, walk(rows, 0.001))}
    assert any(x for x in got.values()) and not all(got.values())


@pytest.mark.parametrize("name", ["segments", "insulation", "merge", "normalize", "epoch", "steps"])
def test_one_vehicle_spreads_over_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(stretches, "STRETCH", 11)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = STEPS[name](frames(spark).where("vehicle_id = 'long'"))
        by_task = {x[0]: x[1] for x in out.groupBy(F.spark_partition_id()).count().collect()} if name != "events" else {}
        assert len(by_task) >= 3 and max(by_task.values()) < ROWS
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
