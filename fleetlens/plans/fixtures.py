"""Telemetry, labels, samples and predictions derived from the event and embedding tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sensors import FAULTS, array_sum
from ..operators import events, labels, windows

CELLS, PROBES = 16, 8
MAX_GAP, WINDOW, STEP, HORIZON, ROLLING = 86400, 6, 3, 4, 10
PACK = (92, 34)
#: The reference sizes of windows, gaps and running means, for the long vehicles.
LONG = {"max_gap": 20, "window": 30, "step": 3, "horizon": 6, "rolling": 300}
MODELS = ("threshold_trend", "lightgbm", "lstm")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.withColumn("vehicle_id", F.concat(F.lit("V"), F.col("user_id")))
    index = F.row_number().over(Window.partitionBy("vehicle_id").orderBy("ts", "event_id")) - 1  # by the column that later steps go by: sensor arrays come after this exchange
    return e.withColumns({"frame_index": index, "timestamp": F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))})


def _with_vectors(spark: SparkSession, sf_dir: str, volts: Column, temps: Column) -> DataFrame:
    """Events with what ``volts`` and ``temps`` make of their embedding, made once by embedding."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    vectors = vectors.select(F.col("vec_id").alias("_vec"), volts.alias("_volts"), temps.alias("_temps"))
    return _events(spark, sf_dir).withColumn("_vec", F.col("event_id") % max(n, 1)).join(vectors, "_vec")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical frame table, with event_id, value and event_type beside it.  The embedding of a frame is a join, not a broadcast by force."""
    item = lambda i: F.element_at("embedding", i).cast("double")
    volts = F.transform(F.sequence(F.lit(1), F.lit(CELLS)), lambda i: F.lit(3.6) + F.lit(0.2) * item(i))
    temps = F.transform(F.sequence(F.lit(CELLS + 1), F.lit(CELLS + PROBES)), lambda i: F.lit(30.0) + F.lit(40.0) * item(i))
    e = _with_vectors(spark, sf_dir, volts, temps)
    drop = F.lit(0.004) * F.greatest(F.col("value") - 100, F.lit(0.0))
    volts = F.transform("_volts", lambda x, i: x - F.when(F.col("user_id") % CELLS == i, drop).otherwise(F.lit(0.0)))
    temps = F.transform("_temps", lambda x: x + F.lit(0.3) * F.col("value"))
    status = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 4).otherwise(3)
    e = e.withColumns({"voltages": volts, "temperatures": temps, "charge_status": status, "soc": (F.col("event_id") % 101).cast("double"), "speed": (F.col("event_id") % 121).cast("double"), "sum_current": (F.col("event_id") % 61 - 30).cast("double"), "insulation_resistance": F.lit(5.0) * F.col("value")})
    e = e.withColumn("sum_voltage", array_sum(F.col("voltages")))
    return e.select("vehicle_id", "frame_index", "timestamp", "charge_status", "speed", "sum_voltage", "sum_current", "soc", "insulation_resistance", "voltages", "temperatures", "event_id", "value", "event_type", "ts")


def pack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of packs of 92 cells and 34 probes: the embedding's items in turn, each round a little higher."""
    cells, probes = PACK
    item = lambda i: F.element_at("embedding", (i % F.size("embedding") + 1).cast("int")).cast("double")
    volts = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.lit(3.6) + F.lit(0.2) * item(i) + F.lit(0.001) * i)
    temps = F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: F.lit(30.0) + F.lit(40.0) * item(i * 3))
    e = _with_vectors(spark, sf_dir, volts, temps)
    volts, temps = F.col("_volts"), F.transform("_temps", lambda x: x + F.lit(0.3) * F.col("value"))
    return e.select("vehicle_id", "frame_index", volts.alias("voltages"), temps.alias("temperatures"))


def long_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few long vehicles, one by event type, with a row each ten seconds and a pause after every 400 rows."""
    e = table(spark, sf_dir, "events").withColumn("vehicle_id", F.concat(F.lit("L"), F.col("event_type")))
    e = e.withColumn("frame_index", F.row_number().over(Window.partitionBy("vehicle_id").orderBy("ts", "event_id")) - 1)
    e = e.withColumn("timestamp", (F.col("frame_index") * 10 + F.floor(F.col("frame_index") / 400) * 60).cast("long"))
    volt = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.lit(3.7) + ((F.col("event_id") * i) % 101) / 5000.0 - F.when(i == 2, F.col("value") / 1000.0).otherwise(F.lit(0.0)))
    rules = {"sd": F.col("value") > 60, "isc": F.col("event_id") % 31 == 0, "conn": F.col("event_id") % 17 < 3, "samp": F.col("event_id") % 11 < 2, "ins": F.col("value") < 2}
    e = e.withColumns({"voltages": volt, "quality_flag": F.when(F.col("event_id") % 29 == 0, "low").otherwise("ok"), **{f"label_final_{f}": rules[f].cast("int") for f in FAULTS}})
    e = e.select("vehicle_id", "frame_index", "timestamp", "voltages", "quality_flag", *(f"label_final_{f}" for f in FAULTS))
    return labels.segments(e, LONG["max_gap"])


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor arrays as joined text with damage: an item short, one too many, an empty string, a word, a null."""
    join = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.4f", x)), "~")
    df = frames(spark, sf_dir).withColumns({"v": join("voltages"), "t": join("temperatures")})
    k = F.col("event_id")
    v = F.when(k % 23 == 0, F.substring_index("v", "~", CELLS - 1)).when(k % 29 == 0, F.concat("v", F.lit("~9.9"))).when(k % 31 == 0, F.lit("")).when(k % 37 == 0, F.lit(None)).when(k % 41 == 0, F.concat(F.lit("bad~"), F.substring_index("v", "~", -(CELLS - 1)))).otherwise(F.col("v"))
    return df.select("vehicle_id", "frame_index", "event_id", F.when(k % 7 != 0, F.col("timestamp")).alias("terminaltime"), F.col("charge_status").alias("chargestatus"), v.alias("batteryvoltage"), F.col("t").alias("probetemperatures"), F.when(k % 13 != 0, F.col("insulation_resistance")).alias("insulationresistance"))


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with simple label_raw_* columns and a quality flag; no segments, no sensor arrays."""
    e = _events(spark, sf_dir)
    status = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 4).otherwise(3)
    k, v = F.col("event_id"), F.col("value")
    rules = {"sd": v > 40, "isc": (F.col("event_type") == "error") & (v > 25), "conn": k % 17 == 0, "samp": k % 11 < 2, "ins": status.isin(1, 2) & (v < 9)}
    e = e.withColumns({"charge_status": status, **{f"label_raw_{f}": rules[f].cast("int") for f in FAULTS}})
    quality = F.when(k % 29 == 0, F.lit("low")).otherwise(F.lit("ok"))
    e = e.withColumns({"quality_flag": quality, "source_dataset": F.when(F.col("user_id") % 4 == 0, "raw_dataset").otherwise("structured_dataset")})
    return e.select("vehicle_id", "frame_index", "timestamp", "charge_status", "event_id", "value", "quality_flag", "source_dataset", *(f"label_raw_{f}" for f in FAULTS))


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label_rows`` with segments."""
    return labels.segments(label_rows(spark, sf_dir), MAX_GAP)


def final_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.smooth_labels(raw_labels(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sample_windows(final_labels(spark, sf_dir), WINDOW, STEP, HORIZON)


def split_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third vehicle to test, val, train in turn."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return u.select(F.concat(F.lit("V"), F.col("user_id")).alias("vehicle_id"), F.when(F.col("user_id") % 3 == 0, "train").when(F.col("user_id") % 3 == 1, "val").otherwise("test").alias("split"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows by event: scores and truths from hashes of the event and its value."""
    e = _events(spark, sf_dir)
    k, v = F.col("event_id"), F.least(F.col("value"), F.lit(100.0)) / 100.0
    rows = e.select("vehicle_id", F.concat(F.lit("S"), k).alias("sample_id"), k.alias("event_id"), F.col("user_id"), v.alias("v"), F.col("timestamp").alias("end_time"), F.posexplode(F.array(*map(F.lit, FAULTS))).alias("k", "fault_type"))
    score = ((F.col("event_id") * 7 + F.col("k") * 13) % 97).cast("double") / 97.0 * 0.6 + F.col("v") * 0.4
    noise = ((F.col("event_id") * 5 + F.col("k") * 11) % 89).cast("double") / 89.0
    truth = (score * 0.5 + F.col("v") * 0.2 + noise * 0.3 > 0.38).cast("int")
    model = reduce(lambda a, b: a.when(F.col("event_id") % 3 == b[0], b[1]), list(enumerate(MODELS))[1:], F.when(F.col("event_id") % 3 == 0, MODELS[0]))
    out = rows.withColumns({"y_score": score, "y_true": truth, "threshold": F.lit(0.5), "model_name": model, "task_type": F.when(F.col("event_id") % 2 == 0, "warn").otherwise("id"), "split": F.when(F.col("user_id") % 3 == 0, "train").when(F.col("user_id") % 3 == 1, "val").otherwise("test"), "lead_time_sec": F.when(F.col("event_id") % 5 != 0, (1 + F.col("event_id") % 6) * 10)})
    return out.withColumn("y_pred", (F.col("y_score") >= F.col("threshold")).cast("int")).drop("v", "k")
