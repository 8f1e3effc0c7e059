"""Case examples: a telling true positive and a telling false negative, with the rows around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import KEY

_ORDER = ("end_time", "sample_id")
#: About as many rows as one task puts in order.
ROWS = 250_000


def joined_predictions(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """Predictions with their sample's times; a prediction without sample keeps nulls."""
    return predictions.join(samples.select("sample_id", KEY, "start_time", "end_time"), ["sample_id", KEY], "left")


def _placed(rows: DataFrame, *more: str) -> DataFrame:
    """Rows with an end time, and their place within vehicle and fault (and the columns ``more``).

    For true positives _run is the same number throughout a run of them: their place less how many there were so far.  One sort serves both.
    """
    w = Window.partitionBy("fault_type", KEY, *more).orderBy(*_ORDER)
    hit = (F.col("y_true") == 1) & (F.col("y_pred") == 1)
    rows = rows.where("end_time is not null").withColumn("_hit", hit)
    so_far = F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"place": F.row_number().over(w), "_run": F.when(F.col("_hit"), F.row_number().over(w) - so_far)})


def _margin() -> Column:
    return F.col("y_score") - F.col("threshold")


def false_negatives(rows: DataFrame) -> DataFrame:
    """By fault the missed positive with the lowest margin; of equal ones the highest score, then the first in order.

    The least margins come from sums over the rows as they lie; only rows that have one are put in order, and only rows of the vehicles found are counted for the place.
    """
    missed = rows.where("end_time is not null and y_true = 1 and y_pred = 0").withColumn("margin", _margin())
    least = missed.groupBy("fault_type").agg(F.when(F.max(F.col("margin").isNull().cast("int")) == 0, F.min("margin")).alias("_least"))
    missed = missed.join(F.broadcast(least), "fault_type").where(F.col("margin").eqNullSafe(F.col("_least")))
    first = F.row_number().over(Window.partitionBy("fault_type").orderBy("margin", F.desc("y_score"), KEY, *_ORDER))
    case = missed.withColumn("_r", first).where("_r = 1").select("fault_type", KEY, "sample_id", "end_time", "y_score", "threshold", "margin")
    at = case.select("fault_type", KEY, F.struct(*_ORDER).alias("_at"))
    before = rows.where("end_time is not null").join(F.broadcast(at), ["fault_type", KEY]).where(F.struct(*_ORDER) < F.col("_at"))
    before = before.groupBy("fault_type").agg(F.count("*").alias("_before"))
    place = (F.coalesce("_before", F.lit(0)) + 1).cast("int").alias("place")
    none = [F.lit(None).cast("int").alias(c) for c in ("run_start", "run_end")]
    return case.join(F.broadcast(before), "fault_type", "left").select(F.lit("false_negative").alias("case_type"), "fault_type", KEY, "sample_id", "end_time", "y_score", "threshold", "margin", place, *none)


def true_positives(rows: DataFrame) -> DataFrame:
    """By fault the row nearest the centre of the longest run of true positives.

    The first row is found by a minimum along the order that the runs' windows leave, so the rows are not sorted once more by fault.
    The rows are counted first and dealt to as many tasks as keep ``ROWS`` in one, so that what a task sorts does not grow with the table.
    """
    run = Window.partitionBy("fault_type", KEY, "_run")
    rows = rows.where("end_time is not null").select("fault_type", KEY, *_ORDER, "y_true", "y_pred", "y_score", "threshold")
    tasks = max(-(-rows.count() // ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    hits = _placed(rows.repartition(tasks, "fault_type", KEY)).where("_hit").drop("y_true", "y_pred", "_hit")
    hits = hits.withColumns({"_length": F.count("*").over(run), "run_start": F.min("place").over(run), "run_end": F.max("place").over(run)}).withColumn("margin", _margin())
    off = F.abs(F.col("place") - (F.col("run_start") + F.col("run_end")) / 2)
    falling = lambda c: F.struct(F.col(c).isNull(), ~F.isnan(c), -F.col(c))
    order = F.struct(-F.col("_length"), off, falling("margin"), falling("y_score"), KEY, *_ORDER)
    kept = ["y_score", "threshold", "margin", "place", "run_start", "run_end"]
    best = hits.groupBy("fault_type").agg(F.min(F.struct(order.alias("_order"), F.struct(KEY, *_ORDER, *kept).alias("case"))).alias("_best"))
    case = F.col("_best.case")
    return best.select(F.lit("true_positive").alias("case_type"), "fault_type", *(case[c].alias(c) for c in (KEY, "sample_id", "end_time", *kept)))


def case_context(rows: DataFrame, cases: DataFrame, radius: int = 15, lead_in: int = 3) -> DataFrame:
    """Long series around each case: (case_type, fault_type, series, x, x_abs, y).

    A true positive shows its run and up to ``lead_in`` rows before; a false negative ``radius`` rows on both sides.  Only the rows of the cases' vehicles are put in order.
    """
    tp = F.col("case_type") == "true_positive"
    bounds = cases.select("case_type", "fault_type", KEY, F.col("place").alias("_at"), F.when(tp, F.col("run_start") - min(lead_in, radius)).otherwise(F.col("place") - radius).alias("_from"), F.when(tp, F.col("run_end")).otherwise(F.col("place") + radius).alias("_to"))
    near = _placed(rows.join(F.broadcast(bounds), ["fault_type", KEY]), "case_type", "_at", "_from", "_to").where("place between _from and _to")
    values = {"score": "y_score", "threshold": "threshold", "y_true": "y_true"}
    items = F.array(*(F.struct(F.lit(k).alias("series"), F.col(c).cast("double").alias("y")) for k, c in values.items()), F.when(F.col("place") == F.col("_at"), F.struct(F.lit("selected_window").alias("series"), F.lit(0.0).alias("y"))))
    return near.select("case_type", "fault_type", (F.col("place") - F.col("_at")).alias("x"), F.col("end_time").alias("x_abs"), F.inline(F.filter(items, lambda s: s.isNotNull())))


def first_cases(cases: DataFrame, preference: dict[str, list[str]]) -> DataFrame:
    """Of each case type the first fault of its list of preference that has a case."""
    rank = F.lit(None).cast("int")
    for kind, faults in preference.items():
        at = F.array_position(F.array(*map(F.lit, faults)), F.col("fault_type")).cast("int")
        rank = F.when((F.col("case_type") == kind) & (at > 0), at).otherwise(rank)
    ranked = cases.withColumn("_rank", rank).where("_rank is not null")
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy("case_type").orderBy("_rank"))).where("_r = 1").drop("_rank", "_r")
