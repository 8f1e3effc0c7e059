"""Streams in several micro-batches, with rows out of order and late."""

import random

from pyspark.sql import functions as F

from fleetlens.sources.shared import fresh_path
from fleetlens.streaming import fleet

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(spark, batches, schema, build):
    """Each batch of rows as one run of the stream from its checkpoint."""
    root, name = fresh_path(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{root}/in")
            out = build(spark.readStream.schema(schema).parquet(f"{root}/in"))
            out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(out.schema).parquet(f"{root}/out").collect()


def naive_events(labels, gap):
    out = []
    for i in (i for i, x in enumerate(labels) if x):
        if out and i - out[-1][1] - 1 <= gap:
            out[-1][1] = i
        else:
            out.append([i, i])
    return {tuple(e) for e in out}


def test_events_over_batches(spark):
    """Rows come up to three frames late and in any order within a batch; a row far too late is left out; no row marks a vehicle's end."""
    rng, rows, want = random.Random(3), [], set()
    for v in ("a", "b"):
        labels = [int(rng.random() < 0.4) for _ in range(59)] + [1]  # a run is open at the end
        want |= {(v, *e) for e in naive_events(labels, 2)}
        order = sorted(range(60), key=lambda i: i + rng.random() * 3)
        rows += [(v, "sd", i, labels[i], 1000 + 10 * i, k) for k, i in enumerate(order)]
    schema = "vehicle_id string, fault_type string, frame_index int, label int, seconds long"
    batches = [[r[:5] for r in rows if low <= r[5] < low + 15] for low in (0, 15, 30, 45)]
    for b in batches:
        rng.shuffle(b)
    batches[3].append(("b", "sd", 0, 1, 1000))
    build = lambda r: fleet.stream_events(r.withColumn("ts", F.timestamp_seconds("seconds")), 2, 3, 100, "60 seconds")
    open_ends = run(spark, batches, schema, build)
    assert {(r.vehicle_id, r.start_frame, r.end_frame) for r in open_ends} == {e for e in want if e[2] < 54}
    got = run(spark, [*batches, [("c", "sd", 0, 0, 9000)], [("c", "sd", 1, 0, 9001)]], schema, build)
    first_b = min(e for e in want if e[0] == "b")
    assert {(r.vehicle_id, r.start_frame, r.end_frame) for r in got} == want and len(got) == len(want) and first_b[2] < 40
    assert all(r.duration_frames == r.end_frame - r.start_frame + 1 for r in got)


def test_segments_over_batches(spark):
    """Sessions that go on over batches; a row behind the watermark is dropped."""
    at = lambda v, *seconds: [(v, s) for s in seconds]
    batches = [at("a", 0, 10, 30) + at("b", 5), at("a", 45, 200) + at("b", 24, 300), at("a", 3000), at("a", 3001, 100), at("c", 9000)]
    build = lambda r: fleet.stream_segments(r.select("vehicle_id", F.timestamp_seconds("seconds").alias("ts")), 20, "60 seconds")
    got = run(spark, batches, "vehicle_id string, seconds long", build)
    found = {(r.vehicle_id, r.rows, int(r.start_time.timestamp()), int(r.end_time.timestamp())) for r in got}
    assert found == {("a", 4, 0, 45), ("a", 1, 200, 200), ("b", 2, 5, 24), ("b", 1, 300, 300), ("a", 2, 3000, 3001)}
