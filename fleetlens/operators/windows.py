"""Sliding windows: samples, targets, and per-vehicle window profiles.

A window is anchored at its last row, so samples are a filter over row frames and nothing is exploded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sensors import FAULTS
from .stretches import KEY, ORDER, with_halo


def sample_windows(labels: DataFrame, window: int = 30, step: int = 3, horizon: int = 6, faults=FAULTS, frame_seconds: int = 10) -> DataFrame:
    """Samples of a vehicle's frames (segment_id, quality_flag, timestamp, label_final_*), with targets.

    Starts are 0, step, ... as long as window and horizon fit; a window that spans segments, or ends in a low-quality
    row, is left out; ids count what is left.  y_id: 1 in two of the last three rows.  y_warn: not y_id, and a 1
    within the horizon; lead_time_sec: the nearest such row over all faults, future_first_fault its fault.
    """
    part = Window.partitionBy(KEY, "_chunk").orderBy(ORDER)
    counted = labels.groupBy(KEY).agg(F.count("*").alias("_n"))
    rows = with_halo(labels, window - 1, horizon)
    start = lambda c: F.lag(c, window - 1).over(part)
    cols = {"start_frame": start(ORDER), "start_time": start("timestamp"), "_segment": start("segment_id")}
    for f in faults:
        c = f"label_final_{f}"
        now = (F.sum(c).over(part.rowsBetween(-2, 0)) >= 2).cast("int")
        ahead = F.array_position(F.collect_list(c).over(part.rowsBetween(1, horizon)), 1)
        cols |= {f"y_id_{f}": now, f"_lead_{f}": ahead}
    rows = rows.withColumns(cols).where("_core and start_frame is not null").join(counted, KEY)
    rows = rows.where((F.col("start_frame") % step == 0) & (F.col("start_frame") <= F.col("_n") - window - horizon))
    rows = rows.where((F.col("_segment") == F.col("segment_id")) & (F.lower("quality_flag") != "low"))
    warn = {f"y_warn_{f}": ((F.col(f"y_id_{f}") == 0) & (F.col(f"_lead_{f}") > 0)).cast("int") for f in faults}
    rows = rows.withColumns(warn)
    leads = F.array(*(F.when(F.col(f"y_warn_{f}") == 1, F.struct(F.col(f"_lead_{f}").alias("lead"), F.lit(k).alias("order"), F.lit(f).alias("fault"))) for k, f in enumerate(faults)))
    rows = rows.withColumn("_first", F.array_min(F.filter(leads, lambda x: x.isNotNull())))
    number = F.row_number().over(Window.partitionBy(KEY).orderBy("start_frame")) - 1
    targets = [f"y_id_{f}" for f in faults] + [f"y_warn_{f}" for f in faults]
    return rows.select(
        F.format_string("%s_%06d", F.col(KEY), number).alias("sample_id"), KEY, "segment_id", "start_time", F.col("timestamp").alias("end_time"), "start_frame", F.col(ORDER).alias("end_frame"), "quality_flag",
        *targets, F.col("_first.fault").alias("future_first_fault"), (F.col("_first.lead") * frame_seconds).cast("int").alias("lead_time_sec"),
    )


def window_profile(samples: DataFrame, faults=FAULTS) -> DataFrame:
    """By vehicle: windows, positives by target, and the vector of faults that occur."""
    sums = [F.sum(f"y_{k}_{f}").alias(f"y_{k}_{f}_positive") for k in ("id", "warn") for f in faults]
    out = samples.groupBy(KEY).agg(F.count("*").alias("window_count"), *sums)
    vector = lambda k: F.concat_ws("|", *(F.when(F.col(f"y_{k}_{f}_positive") > 0, "1").otherwise("0") for f in faults))
    return out.withColumns({"fault_vector": vector("id"), "warning_fault_vector": vector("warn")})


def frames_of_samples(samples: DataFrame, frames: DataFrame, bin_frames: int = 30) -> DataFrame:
    """Samples joined to the frames between start_frame and end_frame, on bins of frames rather than on a range alone."""
    bins = F.sequence(F.floor(F.col("start_frame") / bin_frames), F.floor(F.col("end_frame") / bin_frames))
    left = samples.select("sample_id", KEY, "start_frame", "end_frame", F.explode(bins).alias("_bin"))
    right = frames.withColumn("_bin", F.floor(F.col(ORDER) / bin_frames))
    return left.join(right, [KEY, "_bin"]).where(F.col(ORDER).between(F.col("start_frame"), F.col("end_frame"))).drop("_bin")


def features_with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Frame features and labels on (vehicle, frame); raises where one side lacks a row of the other."""
    both = features.withColumn("_f", F.lit(True)).join(labels.withColumn("_l", F.lit(True)), [KEY, ORDER], "full_outer")
    gap = F.col("_f").isNull() | F.col("_l").isNull()
    ok = F.when(gap, F.raise_error(F.concat(F.lit("features and labels differ at "), F.col(KEY), F.lit(" "), F.col(ORDER).cast("string")))).otherwise(F.lit(True))
    return both.where(ok.cast("boolean")).drop("_f", "_l")


def completeness(samples: DataFrame, tensors: DataFrame) -> DataFrame:
    """(issue, sample_id): ids that repeat on either side, or stand on one side only."""
    twice = lambda df, name: df.groupBy("sample_id").count().where("count > 1").select(F.lit(name).alias("issue"), "sample_id")
    only = lambda a, b, name: a.select("sample_id").distinct().join(b, "sample_id", "left_anti").select(F.lit(name).alias("issue"), "sample_id")
    parts = [twice(samples, "duplicate_sample"), twice(tensors, "duplicate_tensor"), only(samples, tensors, "missing_tensor"), only(tensors, samples, "missing_sample")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
