"""Gap merging and events: gaps and islands over each vehicle's labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sensors import FAULTS
from .stretches import KEY, ORDER, in_stretches, inside, with_halo


def _merged(df: DataFrame, columns: dict[str, str], max_gap: int) -> DataFrame:
    """Adds for each ``out: column`` the column with runs of at most ``max_gap`` zeros between ones filled.

    Only the ``max_gap`` rows on either side matter, so rows go by stretches with as many rows around them.
    """
    w, names = inside(), [c for c in df.columns if c not in columns]
    ones = {f"_at_{o}": F.when(F.col(c) == 1, F.col(ORDER)) for o, c in columns.items()}
    df = with_halo(df, max_gap, max_gap).withColumns(ones)
    last = {o: F.max(f"_at_{o}").over(w.rowsBetween(-max_gap, 0)) for o in columns}
    following = {o: F.min(f"_at_{o}").over(w.rowsBetween(0, max_gap)) for o in columns}
    filled = {o: F.coalesce((F.col(c) == 1) | (following[o] - last[o] - 1 <= max_gap), F.lit(False)) for o, c in columns.items()}
    df = df.select(*df.columns, *(x.cast("int").alias(f"_new_{o}") for o, x in filled.items())).where("_core")
    return df.select(*names, *(F.col(f"_new_{o}").alias(o) for o in columns))


def merge_short_gaps(df: DataFrame, column: str, out: str, max_gap: int = 2) -> DataFrame:
    """Adds ``out``: ``column`` with runs of at most ``max_gap`` zeros between ones filled."""
    return _merged(df, {out: column}, max_gap)


def smooth_labels(df: DataFrame, max_gap: int = 2, faults=FAULTS) -> DataFrame:
    """label_raw_* to label_final_*, all over one ordering."""
    return _merged(df, {f"label_final_{f}": f"label_raw_{f}" for f in faults}, max_gap)


def long_labels(df: DataFrame, prefix: str = "label_final_", faults=FAULTS) -> DataFrame:
    return df.unpivot([KEY, ORDER], [f"{prefix}{f}" for f in faults], "_name", "label").select(KEY, ORDER, F.expr(f"substring(_name, {len(prefix) + 1})").alias("fault_type"), "label")


def extract_events(labels: DataFrame, frame_seconds: int = 10) -> DataFrame:
    """Maximal runs of 1 by vehicle and fault, numbered from 1 on.

    Runs are found inside stretches of rows first; those that touch the ends of neighbouring stretches are then joined, a row a run.
    """
    w, stretch = Window.partitionBy(KEY, "fault_type", "_chunk").orderBy(ORDER), Window.partitionBy(KEY, "fault_type", "_chunk")
    rows = in_stretches(labels.select(KEY, "fault_type", ORDER, "label"))
    rows = rows.withColumns({"_i": F.row_number().over(w), "_rows": F.count("*").over(stretch), "_ones": F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).over(w)}).where("label = 1")
    runs = rows.groupBy(KEY, "fault_type", "_chunk", (F.col("_i") - F.col("_ones")).alias("_island")).agg(
        F.min(ORDER).alias("start_frame"), F.max(ORDER).alias("end_frame"), F.count("*").alias("duration_frames"),
        (F.min("_i") == 1).alias("_from_start"), (F.max("_i") == F.max("_rows")).alias("_to_end"),
    )
    run = Window.partitionBy(KEY, "fault_type").orderBy("start_frame")
    goes_on = F.col("_from_start") & F.lag("_to_end").over(run) & (F.lag("_chunk").over(run) == F.col("_chunk") - 1)
    runs = runs.withColumn("_opens", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("event_id", F.sum("_opens").over(run).cast("int"))
    whole = runs.groupBy(KEY, "fault_type", "event_id").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.sum("duration_frames").cast("long").alias("duration_frames"))
    return whole.select(KEY, "fault_type", "event_id", "start_frame", "end_frame", "duration_frames", (F.col("duration_frames") * frame_seconds).cast("long").alias("duration_seconds"))


def first_events(events: DataFrame) -> DataFrame:
    """The first event of each vehicle and fault."""
    return events.groupBy(KEY, "fault_type").agg(F.min_by(F.struct("event_id", "start_frame", "end_frame", "duration_frames", "duration_seconds"), "start_frame").alias("e")).select(KEY, "fault_type", "e.*")
