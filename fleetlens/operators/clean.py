"""Repair of telemetry columns: time, sensor arrays, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sensors import finite_array
from ..sources.shared import Scratch
from .quantiles import array_quantiles
from .stretches import KEY, ORDER, carried, in_stretches, inside


#: Places of zeros are told by one long a vehicle.
_BITS = 62


def over(key: str = KEY, order: str = ORDER) -> Window:
    return Window.partitionBy(key).orderBy(order)


def epoch_seconds(df: DataFrame, column: str, out: str = "timestamp", key: str = KEY, order: str = ORDER) -> DataFrame:
    """Adds ``out``: whole seconds from a column of numbers or of date-times (decided by vehicle), as long.

    Nulls are interpolated by position between their neighbours, at the ends the nearest value holds; halves round to even.
    A token that fits neither form raises an error.  A vehicle with no value at all stays null.  Rows go by stretches.
    """
    names = [c for c in df.columns if c != out]
    text = F.trim(F.col(column).cast("string"))
    text = F.when(text != "", text)
    df = in_stretches(df, order).withColumns({"_text": text, "_number": text.try_cast("double"), "_moment": text.try_cast("timestamp").cast("double")})
    at = {k: F.when(F.col(f"_{k}").isNotNull(), F.col(order)) for k in ("number", "moment")}
    parts = {"texts": F.count("_text"), "numbers": F.count("_number")}
    before, after = {}, {}
    for k, place in at.items():  # both forms, as the vehicle's form is known only with all stretches
        parts |= {f"last_{k}": F.max(place), f"last_{k}_value": F.max_by(f"_{k}", place), f"first_{k}": F.min(place), f"first_{k}_value": F.min_by(f"_{k}", place)}
        last = lambda c: lambda w: F.last(c, ignorenulls=True).over(w)
        before |= {f"_b_{k}": last(f"_last_{k}"), f"_b_{k}_value": last(f"_last_{k}_value")}
        after |= {f"_a_{k}": last(f"_first_{k}"), f"_a_{k}_value": last(f"_first_{k}_value")}
    df = carried(df, parts, before, after, {"_numeric": lambda w: F.sum("_texts").over(w) == F.sum("_numbers").over(w)}, key)
    pick = lambda a, b: F.when(F.col("_numeric"), F.col(a)).otherwise(F.col(b))
    value = pick("_number", "_moment")
    bad = F.col("_text").isNotNull() & value.isNull()
    df = df.withColumn("_value", F.when(bad, F.raise_error(F.concat(F.lit("no time: "), F.col("_text"))).cast("double")).otherwise(value))
    known = F.when(F.col("_value").isNotNull(), F.struct(F.col(order).cast("long").alias("at"), F.col("_value").alias("value")))
    far = lambda s: F.when(pick(f"_{s}_number", f"_{s}_moment").isNotNull(), F.struct(pick(f"_{s}_number", f"_{s}_moment").cast("long").alias("at"), pick(f"_{s}_number_value", f"_{s}_moment_value").alias("value")))
    near = lambda down: F.last("_known", ignorenulls=True).over(inside(key, order, down).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_known", known).withColumns({"_before": F.coalesce(near(False), far("b")), "_after": F.coalesce(near(True), far("a"))})
    b, a = F.col("_before"), F.col("_after")
    line = b.value + (a.value - b.value) * ((F.col(order) - b["at"]) / (a["at"] - b["at"]))
    value = F.when(F.col("_value").isNotNull(), F.col("_value")).when(b.isNull(), a.value).when(a.isNull(), b.value).otherwise(line)
    return df.select(*names, F.rint(value).cast("long").alias(out))


def normalize_sensors(df: DataFrame, column: str, ok: str, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Gives every row's array its vehicle's usual length, and adds ``ok``: whether it had it before.

    The usual length is the most frequent one of non-empty arrays (of equally frequent ones the first seen).  Longer arrays
    are cut, shorter ones padded with their last item, empty (or null) ones take the row before, zeros if there is none.  Rows go by stretches.
    """
    names = df.columns
    size = F.coalesce(F.size(column), F.lit(0))
    lengths = df.where(size > 0).groupBy(key, size.alias("_n")).agg(F.count("*").alias("_rows"), F.min(order).alias("_first"))
    usual = lengths.groupBy(key).agg(F.max_by("_n", F.struct("_rows", -F.col("_first"))).alias("_usual"))
    df = df.join(usual, key, "left").withColumn("_usual", F.coalesce("_usual", F.lit(0)))
    pad = F.greatest(F.col("_usual") - size, F.lit(0))
    fitted = F.when(size >= F.col("_usual"), F.slice(column, 1, F.col("_usual"))).otherwise(F.concat(column, F.array_repeat(F.element_at(column, -1), pad)))
    df = in_stretches(df, order).withColumn("_fitted", F.when(size > 0, fitted))
    last = {"fitted": F.max_by("_fitted", F.when(F.col("_fitted").isNotNull(), F.col(order)))}
    df = carried(df, last, {"_earlier": lambda w: F.last("_fitted", ignorenulls=True).over(w)}, key=key)
    kept = F.last("_fitted", ignorenulls=True).over(inside(key, order).rowsBetween(Window.unboundedPreceding, 0))
    zeros = F.array_repeat(F.lit(0.0), F.col("_usual"))
    df = df.withColumns({"_kept": F.coalesce(kept, F.col("_earlier"), zeros), "_ok": (size == F.col("_usual")) & (size > 0)})
    return df.select(*(F.col("_kept").alias(c) if c == column else F.col(c) for c in names if c != ok), F.col("_ok").alias(ok))


def quality_flag(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), F.lit("ok")).otherwise(F.lit("low"))


def sensor_medians(df: DataFrame, column: str, key: str = KEY, everywhere: bool = True) -> DataFrame:
    """(key, _medians, _unit): each cell's median of values other than 0 (0 if there is none), and 1000 for a vehicle in thousandths, else 1.

    ``column`` holds finite numbers.  Medians are exact and no task holds a cell's whole life.  Without ``everywhere`` only vehicles with a zero have medians, and
    there only the cells that have one; other places are 0.
    """
    unit = F.when(F.col("_most") > 1000, F.lit(1000.0)).otherwise(F.lit(1.0)).alias("_unit")
    has_zero = F.array_contains(column, F.lit(0.0))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i % _BITS)
    zeros = F.aggregate(F.transform(column, lambda x, i: F.when(x == 0, bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    most = F.greatest(F.array_max(column), -F.array_min(column))
    size = df.groupBy(key).agg(F.max(F.size(column)).alias("_size"), F.max(most).alias("_most"), F.bit_or(F.when(has_zero, zeros)).alias("_zeros"), F.count("*").alias("_rows"))
    size = Scratch(df.sparkSession).keep(size, "sizes")  # a row a vehicle
    cells = df.select(key, column)
    if not everywhere:  # only the values of cells with a zero, the others as null; places that share a bit go along
        if size.where("_zeros <> 0").isEmpty():
            return size.select(key, F.array_repeat(F.lit(0.0), F.greatest("_size", F.lit(0))).alias("_medians"), unit)
        cells = cells.join(size.where("_zeros <> 0").select(key, "_zeros"), key)
        cells = cells.select(key, F.transform(column, lambda x, i: F.when(F.col("_zeros").bitwiseAND(bit(i)) != 0, x)).alias(column))
    medians = array_quantiles(cells, key, column, (0.5,), by_place=True, zeros=False, lengths=size)
    medians = medians.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("cell", F.col("q")[0]))).alias("_by_cell"))
    each = F.transform(F.sequence(F.lit(0), F.col("_size") - 1), lambda i: F.coalesce(F.try_element_at("_by_cell", i), F.lit(0.0)))
    none = F.array().cast("array<double>")
    each = F.when(F.col("_size") <= 0, none).when(F.col("_by_cell").isNull(), F.array_repeat(F.lit(0.0), F.col("_size"))).otherwise(each)
    return size.join(medians, key, "left").select(key, each.alias("_medians"), unit)


def sanitize(df: DataFrame, column: str, key: str = KEY, medians: str | None = None) -> DataFrame:
    """Non-finite items become 0; a vehicle whose largest absolute item is over 1000 is in thousandths; zeros become the median of the cell's other values.

    With ``medians`` a column of that name has the cells' medians (those of the result are the same); else medians are sought only for cells with a zero.
    """
    df = df.withColumn(column, finite_array(F.col(column)))
    df = df.join(sensor_medians(df, column, key, medians is not None), key, "left")
    filled = F.zip_with(column, F.slice("_medians", 1, F.size(column)), lambda x, m: F.when(x == 0, m).otherwise(x))
    scaled = lambda a: F.transform(F.array(F.struct(a.alias("a"), F.col("_unit").alias("u"))), lambda s: F.transform(s.a, lambda x: x / s.u))[0]
    filled = F.when(F.array_contains(column, F.lit(0.0)), filled).otherwise(F.col(column))
    df = df.withColumn(column, F.when(F.col("_unit") > 1, scaled(filled)).when(F.col("_unit") == 1, filled).otherwise(F.col(column)))
    if medians:
        df = df.withColumn(medians, scaled(F.col("_medians")))
    return df.drop("_medians", "_unit")


def select_labels(df: DataFrame, faults, raw: bool = False, ignore_quality: bool = False) -> DataFrame:
    """The label-quality variants: raw labels instead of the smoothed ones, and quality taken as ok throughout."""
    changes = {f"label_final_{f}": F.col(f"label_raw_{f}") for f in faults} if raw else {}
    if ignore_quality:
        changes["quality_flag"] = F.lit("ok")
    return df.withColumns(changes) if changes else df


def only_vehicles(df: DataFrame, ids: str, key: str = KEY) -> DataFrame:
    """Rows of the vehicles in a comma-separated list; an empty list keeps all."""
    wanted = [x.strip() for x in ids.split(",") if x.strip()]
    return df.where(F.col(key).isin(wanted)) if wanted else df
