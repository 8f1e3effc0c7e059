"""Events of streams by buckets of keys: the same as key by key, few calls, and nothing left open."""

import random

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__
from fleetlens.sources.shared import fresh_path
from fleetlens.streaming import fleet

GAP, DELAY, SILENCE = 2, 1, 40


class State:
    """What the function uses of Spark's state."""

    def __init__(self):
        self.get, self.due, self.now, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.get is not None)

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, x):
        self.get = x

    def remove(self):
        self.get = self.due = None

    def setTimeoutTimestamp(self, at):
        assert at > self.now
        self.due = at


class Key:
    """One (vehicle, fault) by sets and loops; ``end`` is when it closes."""

    def __init__(self):
        self.newest, self.emitted, self.end, self.at = -1, -1 - GAP, -1, set()

    def runs(self):
        out = []
        for i in sorted(self.at):
            if out and i - out[-1][1] - 1 <= GAP:
                out[-1][1] = i
            else:
                out.append([i, i])
        return [tuple(r) for r in out]

    def take(self, rows, now):
        self.newest = max(self.newest, *(r[0] for r in rows))
        self.at |= {i for i, one, _ in rows if one and i > self.emitted + GAP}
        done = [r for r in self.runs() if self.newest - r[1] > GAP + DELAY]
        if done:
            self.emitted = done[-1][1]
            self.at = {i for i in self.at if i > self.emitted}
        self.end = max(self.end, max(r[2] for r in rows) + SILENCE, now + 1)
        return done


def test_bucket_equals_keys():
    """Rows in any order, in parts, some far too late; keys that fall silent, come back, or are null; a call by rows and one by time."""
    for seed in range(40):
        rng, state, keys = random.Random(seed), State(), {}
        call = fleet._events_of_bucket(GAP, DELAY, SILENCE)
        names = [(f"v{k}", f) for k in range(3) for f in ("sd", "ins")] + [(None, "sd")]
        for k in range(12):
            state.now = 25 * k
            heard = [n for n in names if rng.random() < (0.5 if k < 9 else 0.1)]
            rows = [(*n, i, int(rng.random() < 0.4), 25 * k + rng.randrange(30)) for n in heard for i in {max(0, 6 * k + rng.randrange(-7, 8)) for _ in range(rng.randrange(1, 9))}]
            rng.shuffle(rows)
            want = {(*n, *r) for n in set(heard) for r in keys.setdefault(n, Key()).take([x[2:] for x in rows if x[:2] == n], state.now)}
            for n in [n for n, x in keys.items() if n not in heard and x.end < state.now]:
                want |= {(*n, *r) for r in keys.pop(n).runs()}
            state.hasTimedOut = not rows
            got = []
            if rows or (state.due is not None and state.due < state.now):
                frame = pd.DataFrame(rows, columns=["vehicle_id", "fault_type", "frame_index", "label", "millis"])
                for out in call((0,), iter([frame[a : a + 5] for a in range(0, len(frame), 5)]), state):
                    got += list(out.itertuples(index=False, name=None))
            assert {x[:4] for x in got} == want and len(got) == len(want) and all(x[4] == x[3] - x[2] + 1 for x in got)
            assert state.exists == bool(keys)


def test_columns_of_labels_equal_rows():
    """A row a frame with a column of labels for each fault gives the events and the state that a row for each fault gives."""
    rng, faults, found = random.Random(5), {"sd": "a", "ins": "b"}, 0
    long, wide = State(), State()
    for k in range(6):
        frames = pd.DataFrame([(f"v{v}", i, int(rng.random() < 0.4), int(rng.random() < 0.4), 25 * k) for v in range(4) if rng.random() < 0.7 for i in range(9 * k, 9 * k + 9)] or [("v0", 9 * k, 1, 1, 25 * k)], columns=["vehicle_id", "frame_index", "a", "b", "millis"])
        rows = pd.concat([frames.assign(fault_type=f, label=frames[c]) for f, c in faults.items()])
        got = []
        for state, part, names in ((long, rows, None), (wide, frames, faults)):
            state.now = 25 * k
            outs = fleet._events_of_bucket(GAP, DELAY, SILENCE, names)((0,), iter([part[:7], part[7:]] if len(part) > 7 else [part]), state)
            got.append(sorted(x for out in outs for x in out.itertuples(index=False, name=None)))
        found += len(got[0])
        assert got[0] == got[1] and long.due == wide.due
        assert sorted(zip(*long.get[:5])) == sorted(zip(*wide.get[:5])) and len(long.get[5]) == len(wide.get[5])
    assert found > 20


def test_state_goes_by_buckets(spark):
    """300 keys in eight buckets: Python is called, and state kept, eight times."""
    root = fresh_path(spark, "stream")
    spark.range(3000).selectExpr("concat('v', id % 100) vehicle_id", "concat('f', id % 3) fault_type", "id div 300 frame_index", "1 label", "timestamp_seconds(id) ts").write.parquet(f"{root}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    query = fleet.stream_events(rows, buckets=8).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal == 8


def test_all_events_of_a_short_time(spark, tmp_path):
    """All rows within 80 seconds: the last runs come out too, as they do from the batch job."""
    events = spark.range(120).select(F.col("id").alias("event_id"), F.timestamp_seconds(1000 + F.floor(F.col("id") * 2 / 3)).alias("ts"), (F.col("id") % 4).alias("user_id"), F.lit("error").alias("event_type"), (F.col("id") % 50).cast("double").alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    names = ["vehicle_id", "fault_type", "start_frame", "end_frame", "duration_frames"]
    got, want = (sorted(map(tuple, __spark_entry__.queries()[q](spark, str(tmp_path)).select(names).collect())) for q in ("str2_events", "evt2_events"))
    assert got == want and len(want) > 10
