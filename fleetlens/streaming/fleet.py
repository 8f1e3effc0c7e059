"""Streams of frames: segments by session windows, and events by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "vehicle_id string, fault_type string, start_frame long, end_frame long, duration_frames long"
STATE = "vehicle_id array<string>, fault_type array<string>, newest array<long>, emitted array<long>, closes array<long>, of array<long>, first array<long>, last array<long>"
NEVER = np.iinfo("int64").min


def stream_segments(frames: DataFrame, max_gap: int = 20, delay: str = "10 minutes") -> DataFrame:
    """(vehicle_id, rows, start_time, end_time) of each segment: sessions with gaps of at most ``max_gap`` whole seconds.

    A session is emitted once the watermark (``delay`` behind the newest row) has passed it; rows behind the watermark are
    dropped.  On a batch table the same plan gives all segments.  ``frames`` has vehicle_id and ts.
    """
    session = F.session_window("ts", f"{max_gap} seconds")
    found = frames.withWatermark("ts", delay).groupBy("vehicle_id", session)
    return found.agg(F.count("*").alias("rows"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time")).drop("session_window")


def _merged(of: np.ndarray, first: np.ndarray, last: np.ndarray, max_gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order of their keys ``of`` and first frames, those of a key with at most ``max_gap`` frames between them as one."""
    order = np.lexsort((first, of))
    of, first, last = of[order], first[order], last[order]
    reach = pd.Series(last).groupby(of).cummax().to_numpy()
    opens = np.ones(len(of), dtype=bool)
    opens[1:] = (of[1:] != of[:-1]) | (first[1:] - reach[:-1] - 1 > max_gap)
    at = np.flatnonzero(opens)
    return of[at], first[at], np.maximum.reduceat(last, at) if len(at) else last


def _by_key(part: pd.DataFrame, faults: dict[str, str], keys: dict[tuple, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels with the number of each row's (vehicle, fault) in ``keys``, to which new ones are added: once a column of ``faults``; without any, for rows that name their fault."""
    number = lambda pairs: np.array([keys.setdefault(p, len(keys)) for p in pairs], dtype="int64")
    code = lambda xs: (lambda at, names: (at, [None if x is None or x != x else x for x in names]))(*pd.factorize(xs, use_na_sentinel=False))
    v, vehicles = code(part["vehicle_id"])
    for fault, column in faults.items():
        yield number([(x, fault) for x in vehicles])[v], part[column].to_numpy()
    if not faults:
        f, names = code(part["fault_type"])
        pairs, row = np.unique(v * len(names) + f, return_inverse=True)
        yield number([(vehicles[p // len(names)], names[p % len(names)]) for p in pairs.tolist()])[row], part["label"].to_numpy()


def _events_of_bucket(max_gap: int, delay: int, silence: int, faults: dict[str, str] | None = None):
    """What the (vehicle, fault) keys of a bucket do with its new rows: the runs of label 1 that may still grow stay, gaps of at most ``max_gap`` zeros merged.

    A run is emitted once its key's newest frame is more than ``max_gap + delay`` frames behind it.  Frames up to ``delay`` behind the newest may come in any order; older ones that
    would touch an emitted run, or lie before it, are dropped.  Each input moves a key's end to ``silence`` milliseconds behind its newest row; when the watermark
    passes it, what is open is emitted and the key leaves the state.  So state is as long as the open runs of vehicles that still send.
    """

    def events(bucket, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        *names, newest, emitted, closes, of, first, last = state.get if state.exists else ([],) * 8
        keys = {k: i for i, k in enumerate(zip(*names))}
        newest, emitted, closes, *runs = (np.array(x, dtype="int64") for x in (newest, emitted, closes, of, first, last))
        runs, latest = [runs], np.full(len(keys), NEVER)
        grown = lambda xs, x: np.concatenate([xs, np.full(len(keys) - len(xs), x)])
        for part in () if state.hasTimedOut else rows:  # a part at a time: only its runs are kept
            frames, millis = (part[c].astype("int64").to_numpy() for c in ("frame_index", "millis"))
            labels = list(_by_key(part, faults or {}, keys))
            newest, emitted, closes, latest = grown(newest, -1), grown(emitted, -1 - max_gap), grown(closes, -1), grown(latest, NEVER)
            for of, label in labels:
                np.maximum.at(newest, of, frames)
                np.maximum.at(latest, of, millis)
                one = (label == 1) & (frames > emitted[of] + max_gap)
                runs.append(_merged(of[one], frames[one], frames[one], max_gap))
        of, first, last = _merged(*map(np.concatenate, zip(*runs)), max_gap)
        heard = latest > NEVER
        silent = ~heard & (closes < now)
        closes = np.where(heard, np.maximum(closes, np.maximum(latest + silence, now + 1)), closes)
        done = silent[of] | (newest[of] - last > max_gap + delay)
        np.maximum.at(emitted, of[done], last[done])
        names = list(keys)
        if silent.all():
            state.remove()
        else:
            place, still = np.cumsum(~silent) - 1, np.flatnonzero(~silent)
            kept = [[names[i][k] for i in still.tolist()] for k in (0, 1)]
            state.update((*kept, *(x.tolist() for x in (newest[still], emitted[still], closes[still], place[of[~done]], first[~done], last[~done]))))
            state.setTimeoutTimestamp(max(int(closes[still].min()), now + 1))
        if done.any():
            vehicle, fault = ([names[i][k] for i in of[done].tolist()] for k in (0, 1))
            yield pd.DataFrame({"vehicle_id": vehicle, "fault_type": fault, "start_frame": first[done], "end_frame": last[done], "duration_frames": last[done] - first[done] + 1})

    return events


def stream_events(labels: DataFrame, max_gap: int = 2, delay: int = 0, silence: int = 600, lateness: str = "10 minutes", buckets: int = 1024, faults: dict[str, str] | None = None) -> DataFrame:
    """Events from a stream of (vehicle_id, fault_type, frame_index, label, ts); equal to the batch job on frames that come at most ``delay`` frames late.

    With ``faults``, names and their columns of labels, a row has all labels of a frame in place of fault_type and label, and fewer rows go through the shuffle.
    Rows more than ``lateness`` behind the newest of all are dropped.  A vehicle from which nothing has come for ``silence`` seconds (of the stream's time) is closed: its open runs are emitted.
    State goes by ``buckets`` of (vehicle, fault), or of vehicles, so that Python is called once a bucket and not once a key; a stream that goes on from a checkpoint needs the number it began with.
    """
    names = list(faults.values()) if faults else ["fault_type", "label"]
    bucket = F.pmod(F.xxhash64("vehicle_id", *([] if faults else ["fault_type"])), F.lit(buckets)).alias("bucket")
    rows = labels.withWatermark("ts", lateness).select("vehicle_id", F.col("frame_index").cast("long").alias("frame_index"), *names, "ts", F.unix_millis("ts").alias("millis"), bucket)
    return rows.groupBy("bucket").applyInPandasWithState(_events_of_bucket(max_gap, delay, silence * 1000, faults), EVENT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
