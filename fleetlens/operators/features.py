"""Window features: per-frame scalars first, then row frames, then a filter on the windows' last rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sensors import FAULTS, argmin, array_median, array_range, array_sum, finite, finite_array, neighbour_gap
from .stretches import KEY, ORDER, in_stretches, with_halo

#: Prefixes of the features, and the channels of a sequence.
GROUPS = ("shared", "sd", "isc", "conn", "samp", "ins")
CHANNELS = ("charge_status", "soc", "speed", "sum_voltage", "sum_current", "insulation_resistance", "v_range", "t_range")
#: Limits of the counts below.
STEEP, JUMP, OFF = 0.015, 0.05, 0.03


def frame_scalars(frames: DataFrame) -> DataFrame:
    """One row per frame with the numbers that the window features are made of; no shuffle."""
    df = frames.select(KEY, ORDER, *(finite(F.col(c)).alias(c) for c in CHANNELS[:6]), finite_array(F.col("voltages")).alias("v"), finite_array(F.col("temperatures")).alias("t"))
    df = df.withColumn("median", array_median(F.col("v")))  # columns of their own: written into what uses them, they would be made each time
    df = df.withColumns({"v_range": array_range(F.col("v")), "t_range": array_range(F.col("t")), "weak": F.array_min("v") - F.col("median"), "v_min": F.array_min("v"), "t_max": F.array_max("t"), "weak_cell": argmin(F.col("v")), "v_sum": array_sum(F.col("v")), "gap": neighbour_gap(F.col("v")), "cells": F.size("v")})
    df = df.withColumn("_off", F.zip_with("v", F.array_repeat("median", F.col("cells")), lambda x, m: F.abs(x - m)))
    return df.withColumns({"off_sum": array_sum(F.col("_off")), "off_count": F.size(F.filter("_off", lambda x: x > OFF))}).drop("_off")


def _at_anchors(rows: DataFrame, samples: DataFrame, window: int, column: str, make, schema: str) -> DataFrame:
    """(sample_id, made): ``make`` gets a stretch's matrix of ``column`` (a row a frame) and the places of the windows' last rows in it, and gives a column.

    Rows go by stretches with ``window`` rows around them, samples to the stretch of their last frame; nothing is gathered for other rows.
    """
    rows = with_halo(rows.select(KEY, F.col(ORDER).cast("long").alias(ORDER), column), window, 0)
    anchors = in_stretches(samples.select("sample_id", F.col(KEY).alias("_key"), F.col("end_frame").cast("long").alias(ORDER)))  # another name, as both sides may come from one table

    def one(frames: pa.Table, ends: pa.Table) -> pa.Table:
        frames = frames.sort_by(ORDER)
        items = frames.column(column).combine_chunks()
        widths = np.unique(items.value_lengths().to_numpy(zero_copy_only=False))
        if len(widths) > 1:
            raise ValueError(f"rows of one vehicle differ in length: {widths.tolist()}")
        x = items.flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)
        numbers = frames.column(ORDER).to_numpy()
        place = np.searchsorted(numbers, ends.column(ORDER).to_numpy())
        known = np.flatnonzero((place < len(numbers)) & (numbers[np.minimum(place, len(numbers) - 1)] == ends.column(ORDER).to_numpy()) & (place >= window - 1)) if len(numbers) else np.zeros(0, int)
        return pa.table([ends.column("sample_id").take(pa.array(known)), make(x, place[known])], names=["sample_id", "made"])

    return rows.groupBy(KEY, "_chunk").cogroup(anchors.groupBy("_key", "_chunk")).applyInArrow(one, f"sample_id string, made {schema}")


def _adjacent_icc(window: int):
    """The least intraclass correlation of neighbouring cells in each window, from running sums of x, y, xx, yy and xy."""

    def make(v: np.ndarray, ends: np.ndarray) -> pa.Array:
        if v.shape[1] < 2 or not len(ends):
            return pa.array(np.ones(len(ends)))
        x = v - v.mean(axis=0).mean()
        a, b = x[:, :-1], x[:, 1:]
        sums = []
        for y in (a, b, a * a, b * b, a * b):
            total = np.concatenate([np.zeros((1, y.shape[1])), np.cumsum(y, axis=0)])
            sums.append(total[ends + 1] - total[ends + 1 - window])
        sa, sb, saa, sbb, sab = (t / window for t in sums)
        mean = (sa + sb) / 2
        variance = (saa + sbb) / 2 - mean * (sa + sb) + mean * mean
        covariance = sab - mean * (sa + sb) + mean * mean
        # a window in which both cells keep one value has no variance: counted, as sums leave a rest there
        differ = np.concatenate([np.zeros((1, a.shape[1]), int), np.cumsum(a != b, axis=0)])
        moves = np.concatenate([np.zeros((1, a.shape[1]), int), np.cumsum(np.concatenate([np.zeros((1, a.shape[1]), bool), a[1:] != a[:-1]]), axis=0)])
        still = (differ[ends + 1] == differ[ends + 1 - window]) & (moves[ends + 1] == moves[ends + 2 - window])
        return pa.array(np.where(still, 1.0, covariance / np.where(still, 1.0, variance)).min(axis=1))

    return make


def window_icc(frames: DataFrame, samples: DataFrame, window: int = 30) -> DataFrame:
    """(sample_id, conn_icc_min) of each sample."""
    return _at_anchors(frames.select(KEY, ORDER, finite_array(F.col("voltages")).alias("v")), samples, window, "v", _adjacent_icc(window), "double").withColumnRenamed("made", "conn_icc_min")


def window_features(frames: DataFrame, samples: DataFrame, window: int = 30, with_icc: bool = True) -> DataFrame:
    """sample_id and the 28 features of each sample, unrounded.  The correlation feature has its own pass over the cells (``window_icc``)."""
    rows = with_halo(frame_scalars(frames), window, 0)
    w = Window.partitionBy(KEY, "_chunk").orderBy(ORDER)
    whole, inner = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-(window - 2), 0)
    before = F.lag("v").over(w)
    change = F.coalesce(F.zip_with("v", before, lambda x, y: F.abs(x - y)), F.array().cast("array<double>"))
    rows = rows.withColumns({"_change": change, "_dv": F.col("v_min") - F.lag("v_min").over(w), "_dt": F.col("t_max") - F.lag("t_max").over(w)})
    rows = rows.withColumns({"_most": F.array_max("_change"), "_steep": F.size(F.filter("_change", lambda x: x > STEEP)), "_jump": F.size(F.filter("_change", lambda x: x > JUMP))})
    first = lambda c: F.first(c).over(whole)
    weak = F.collect_list("weak_cell").over(whole)
    resistance = F.collect_list("insulation_resistance").over(whole)
    limit = F.when(F.col("charge_status").cast("int").isin(1, 2), 100 * F.col("sum_voltage")).otherwise(500 * F.col("sum_voltage"))
    total = F.sum("cells").over(whole)
    features = {
        **{f"shared_{c}": F.col(c) for c in CHANNELS[:6]},
        "shared_v_range": F.max("v_range").over(whole), "shared_t_range": F.max("t_range").over(whole),
        "sd_cell_dev_min": F.min("weak").over(whole), "sd_cell_dev_slope": F.col("weak") - first("weak"),
        "sd_weak_cell_repeat_ratio": weak, "sd_rest_drop_rate": F.col("v_min") - first("v_min"),
        "isc_module_vdrop_max": F.min("_dv").over(inner), "isc_module_vrange": F.max("v_range").over(whole),
        "isc_module_tmax": F.max("t_max").over(whole), "isc_module_trise_max": F.max("_dt").over(inner),
        "conn_dvdt_max": F.coalesce(F.max("_most").over(inner), F.lit(0.0)), "conn_neighbor_response_gap": F.max("gap").over(whole),
        "conn_abnormal_point_ratio": F.sum("_steep").over(inner) / F.sum("cells").over(inner),
        "samp_local_median_residual": F.sum("off_sum").over(whole) / total, "samp_sensor_jump_count": F.sum("_jump").over(inner).cast("double"),
        "samp_pack_sum_residual": F.avg(F.col("sum_voltage") - F.col("v_sum")).over(whole), "samp_abnormal_count_ratio": F.sum("off_count").over(whole) / total,
        "ins_rins_min": F.min("insulation_resistance").over(whole), "ins_rins_slope": F.col("insulation_resistance") - first("insulation_resistance"),
        "ins_threshold_margin": F.col("insulation_resistance") - limit,
        "_r": resistance,
    }
    anchors = samples.select("sample_id", KEY, F.col("end_frame").alias(ORDER))
    wide = rows.select(KEY, ORDER, "_core", *(c.alias(k) for k, c in features.items())).where("_core").drop("_core").join(anchors, [KEY, ORDER])
    weak, middle = F.col("sd_weak_cell_repeat_ratio"), array_median(F.col("_r"))
    often = F.array_max(F.transform(F.array_distinct(weak), lambda c: F.size(F.filter(weak, lambda x: x == c))))  # counted at the samples' last rows only
    wide = wide.withColumn("sd_weak_cell_repeat_ratio", often / window)
    wide = wide.withColumn("ins_low_rins_persistence", F.transform(F.array(middle), lambda m: F.size(F.filter("_r", lambda x: x < m)).cast("double"))[0])
    if with_icc:
        wide = wide.join(window_icc(frames, samples, window), "sample_id")
    return wide.select("sample_id", *(c for c in wide.columns if c not in ("sample_id", "_r", KEY, ORDER)))


def window_sequences(frames: DataFrame, samples: DataFrame, window: int = 30) -> DataFrame:
    """sample_id and its window x 8 matrix of floats, gathered at the samples' last rows only."""
    rows = frame_scalars(frames).select(KEY, ORDER, F.array(*(finite(F.col(c)).cast("float") for c in CHANNELS)).alias("x"))

    def cut(x: np.ndarray, ends: np.ndarray) -> pa.Array:
        at = (ends[:, None] + np.arange(1 - window, 1)[None, :]).ravel()
        steps = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * x.shape[1]), pa.array(x[at].ravel().astype(np.float32)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * window), steps)

    return _at_anchors(rows, samples, window, "x", cut, "array<array<float>>").withColumnRenamed("made", "x_seq")


#: The features in the order of the pack.
PACK_FEATURES = (
    *(f"shared_{c}" for c in CHANNELS),
    "sd_cell_dev_min", "sd_cell_dev_slope", "sd_weak_cell_repeat_ratio", "sd_rest_drop_rate",
    "isc_module_vdrop_max", "isc_module_vrange", "isc_module_tmax", "isc_module_trise_max",
    "conn_dvdt_max", "conn_neighbor_response_gap", "conn_abnormal_point_ratio", "conn_icc_min",
    "samp_local_median_residual", "samp_sensor_jump_count", "samp_pack_sum_residual", "samp_abnormal_count_ratio",
    "ins_rins_min", "ins_rins_slope", "ins_threshold_margin", "ins_low_rins_persistence",
)


def dataset_pack(frames: DataFrame, samples: DataFrame, window: int = 30, faults=FAULTS) -> DataFrame:
    """The training pack, a row a sample: sample_id, x_seq (window x 8), x_feat (``PACK_FEATURES``; what is no finite number is 0), y_id, y_warn."""
    wide = window_features(frames, samples, window)
    x_feat = F.array(*(F.coalesce(finite(F.col(c)), F.lit(0.0)).cast("float") for c in PACK_FEATURES))
    targets = samples.select("sample_id", *(F.array(*(F.col(f"y_{k}_{f}").cast("int") for f in faults)).alias(f"y_{k}") for k in ("id", "warn")))
    return window_sequences(frames, samples, window).join(wide.select("sample_id", x_feat.alias("x_feat")), "sample_id").join(targets, "sample_id")


def feature_groups(features: DataFrame, group: str) -> DataFrame:
    """sample_id and the columns of one prefix."""
    return features.select("sample_id", *(c for c in features.columns if c.startswith(f"{group}_")))


def align(features: DataFrame, columns: list[str]) -> DataFrame:
    """sample_id and exactly ``columns`` in this order; a column that is missing, or a null, is 0."""
    return features.select("sample_id", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in features.columns else F.lit(0.0).alias(c) for c in columns))


def train_statistics(features: DataFrame, splits: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each feature over the rows of split train; a deviation under 1e-6 is 1."""
    train = features.join(splits.where("split = 'train'"), "sample_id", "left_semi")
    sd = lambda c: F.stddev_pop(c)
    return train.agg(*(F.avg(c).alias(f"{c}__mean") for c in columns), *(F.when(sd(c) < 1e-6, 1.0).otherwise(sd(c)).alias(f"{c}__std") for c in columns))


def normalise(features: DataFrame, statistics: DataFrame, columns: list[str]) -> DataFrame:
    """Features in deviations from the training mean; ``statistics`` is the one row above."""
    return features.crossJoin(F.broadcast(statistics)).select("sample_id", *(((F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std")).alias(c) for c in columns))


def positive_weights(samples: DataFrame, targets: list[str]) -> DataFrame:
    """(target, weight): negatives by positives between 1 and 100; 1 where a class is absent."""
    sums = samples.agg(F.count("*").alias("n"), *(F.sum(t).alias(t) for t in targets))
    long = sums.unpivot(["n"], targets, "target", "pos")
    ratio = (F.col("n") - F.col("pos")) / F.col("pos")
    return long.select("target", F.when((F.col("pos") == 0) | (F.col("pos") == F.col("n")), 1.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(1.0), ratio))).alias("weight"))
