"""Summaries of labels, vehicles and arbitrary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sensors import FAULTS
from .clean import KEY
from .quantiles import grouped_quantiles

_QUARTILES = (0.25, 0.5, 0.75)


def label_summary(frames: DataFrame, faults=FAULTS) -> DataFrame:
    """By vehicle: rows, and positive frames of every fault."""
    return frames.groupBy(KEY).agg(F.count("*").alias("rows"), *(F.sum(f"label_final_{f}").cast("long").alias(f"positive_{f}") for f in faults))


def label_statistics(frames: DataFrame, faults=FAULTS) -> DataFrame:
    """By source dataset, and for all (scope final): vehicles, rows, positives."""
    out = frames.rollup("source_dataset").agg(F.grouping("source_dataset").alias("_all"), F.countDistinct(KEY).alias("vehicles"), F.count("*").alias("rows"), *(F.sum(f"label_final_{f}").cast("long").alias(f"positive_{f}") for f in faults))
    return out.withColumn("scope", F.when(F.col("_all") == 1, "final").otherwise(F.col("source_dataset"))).drop("_all", "source_dataset")


def vehicle_profile(frames: DataFrame, window: int = 30, step: int = 3, sources=()) -> DataFrame:
    """By vehicle: rows, segments, approximate windows, charge states, and positives of the source's own label columns."""
    windows = F.greatest(F.floor((F.count("*") - window) / step) + 1, F.lit(0)).cast("long")
    return frames.groupBy(KEY).agg(
        F.count("*").alias("rows"), F.max("segment_id").alias("segments"), windows.alias("approx_windows"),
        F.array_join(F.array_sort(F.collect_set(F.col("charge_status").cast("int"))), "|").alias("charge_states"), *(F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(f"source_{c}") for c in sources),
    )


def project_profile(profile: DataFrame, windows: DataFrame, labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """Vehicle profile, window profile, label summary and manifest side by side; a vehicle without windows has 0."""
    out = profile.join(windows, KEY, "left").join(labels.drop("rows"), KEY, "left").join(manifest.select(KEY, "source_dataset", "entry_kind"), KEY, "left")
    return out.withColumn("window_count", F.coalesce("window_count", F.lit(0)))


def fault_coverage(windows: DataFrame, faults=FAULTS, least: int = 2) -> DataFrame:
    """By fault: vehicles with windows of it, and whether they are too few to evaluate."""
    counts = windows.agg(*(F.sum(F.when(F.col(f"y_id_{f}_positive") > 0, 1).otherwise(0)).alias(f) for f in faults))
    long = counts.unpivot([], list(faults), "fault_type", "vehicles")
    return long.select("fault_type", "vehicles", (F.coalesce("vehicles", F.lit(0)) < least).alias("limited"))


def label_distribution(samples: DataFrame, faults=FAULTS) -> DataFrame:
    """(split, task, fault, positives) in long form."""
    names = [f"y_{k}_{f}" for k in ("id", "warn") for f in faults]
    sums = samples.groupBy("split").agg(*(F.sum(n).alias(n) for n in names))
    return sums.unpivot(["split"], names, "target", "positives")


def dataset_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row by column: type, share of nulls in per cent, distinct values, and for numbers mean, deviation, minimum, quartiles, maximum.

    Exact distinct counts and quartiles are counted by (column, value) and by ranges of value, so no task holds a column; with
    ``exact`` off they are sketches, and all is one pass over the table.
    """
    fields = list(enumerate(df.schema.fields))
    column = lambda f: F.col(f"`{f.name}`")
    numbers = {k for k, f in fields if isinstance(f.dataType, T.NumericType)}
    simple = {k for k, f in fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)}
    aggs = [F.count("*").alias("_rows")]
    for k, f in fields:
        aggs.append(F.count(column(f)).alias(f"_n{k}"))
        if k in numbers:
            x = column(f).cast("double")
            aggs += [F.avg(x).alias(f"_m{k}"), F.stddev_samp(x).alias(f"_s{k}"), F.min(x).alias(f"_lo{k}"), F.max(x).alias(f"_hi{k}")]
            if not exact:
                aggs.append(F.percentile_approx(x, list(_QUARTILES)).alias(f"_q{k}"))
        if k in simple and not exact:
            aggs.append(F.approx_count_distinct(column(f)).alias(f"_d{k}"))
    rows = []
    for k, f in fields:
        of = lambda name, has, kind="double", k=k: F.col(f"_{name}{k}") if has else F.lit(None).cast(kind)
        stats = [of(x, k in numbers).alias(y) for x, y in (("m", "mean"), ("s", "std"), ("lo", "min"), ("hi", "max"))]
        rows.append(F.struct(
            F.lit(k).alias("_k"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), ((1 - F.col(f"_n{k}") / F.col("_rows")) * 100).alias("missing_pct"),
            *stats, of("d", k in simple and not exact, "long").alias("distinct"), of("q", k in numbers and not exact, "array<double>").alias("q"),
        ))
    out = df.agg(*aggs).select(F.inline(F.array(*rows)))
    if exact:
        pairs = lambda ks, value: F.array(*(F.struct(F.lit(k).alias("_k"), value(f).alias("_v")) for k, f in fields if k in ks))
        out = out.drop("distinct", "q")
        text = lambda f: F.hex(column(f)) if isinstance(f.dataType, T.BinaryType) else column(f).cast("string")
        distinct = df.select(F.inline(pairs(simple, text))).where("_v is not null").distinct().groupBy("_k").agg(F.count("*").alias("distinct")) if simple else None
        quartiles = grouped_quantiles(df.select(F.inline(pairs(numbers, lambda f: column(f).cast("double")))), ["_k"], "_v", _QUARTILES) if numbers else None
        out = out.join(distinct, "_k", "left") if simple else out.withColumn("distinct", F.lit(None).cast("long"))
        out = out.join(quartiles, "_k", "left") if numbers else out.withColumn("q", F.lit(None).cast("array<double>"))
        counted = F.when(F.array_contains(F.array(*map(F.lit, sorted(simple) or [-1])), F.col("_k")), F.coalesce("distinct", F.lit(0)))
        out = out.withColumn("distinct", counted)
    q = lambda i: F.col("q")[i]
    return out.select("column", "dtype", "missing_pct", "distinct", "mean", "std", "min", q(0).alias("q1"), q(1).alias("median"), q(2).alias("q3"), "max")


#: Of hll sketches: 2^12 registers, a relative error of 1.6 % (one deviation).  Of kll sketches: k of 400, a rank error of 0.7 % (at 99 %).
LG_REGISTERS = 12
KLL_SIZE = 400


def profile_parts(df: DataFrame, by: Column | None = None) -> DataFrame:
    """(part, column, dtype, rows, present, mean, squares, min, max, distinct, ranks): a row for every part and column, to be stored and merged later.

    ``by`` says which part a row belongs to (a day, a load); without it all are part null.  ``distinct`` and ``ranks`` are HLL and KLL
    sketches of bounded size (null where the type has none; ranks of NaN are not kept), ``squares`` is the sum of squared deviations
    from the part's mean.  One pass, combined before the shuffle.
    """
    fields = list(enumerate(df.schema.fields))
    by = F.lit(None).cast("string") if by is None else by.cast("string")
    aggs = [F.count("*").alias("_rows")]
    rows = []
    for k, f in fields:
        c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
        simple = not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)
        aggs.append(F.count(c).alias(f"_n{k}"))
        if number:
            x = c.cast("double")
            aggs += [F.avg(x).alias(f"_m{k}"), (F.var_pop(x) * F.count(x)).alias(f"_s{k}"), F.min(x).alias(f"_lo{k}"), F.max(x).alias(f"_hi{k}")]
            aggs.append(F.kll_sketch_agg_double(F.when(~F.isnan(x), x), KLL_SIZE).alias(f"_q{k}"))
        if simple:
            value = c if isinstance(f.dataType, T.StringType | T.BinaryType) else c.cast("string")
            aggs.append(F.hll_sketch_agg(value, LG_REGISTERS).alias(f"_d{k}"))
        of = lambda name, has, kind, k=k: F.col(f"_{name}{k}") if has else F.lit(None).cast(kind)
        stats = [of(x, number, "double").alias(y) for x, y in (("m", "mean"), ("s", "squares"), ("lo", "min"), ("hi", "max"))]
        rows.append(F.struct(F.lit(k).alias("place"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col("_rows").alias("rows"), F.col(f"_n{k}").alias("present"), *stats, of("d", simple, "binary").alias("distinct"), of("q", number, "binary").alias("ranks")))
    return df.groupBy(by.alias("part")).agg(*aggs).select("part", F.inline(F.array(*rows)))


def merge_parts(parts: DataFrame, quantiles=_QUARTILES) -> DataFrame:
    """The profile of ``dataset_profile`` from stored parts, of which any choice may be given; counts, means, deviations, minimum and maximum
    are exact, distinct values and quartiles within the sketches' errors.  No row of the table itself is read again."""
    n, mean = F.sum("present"), F.sum(F.col("mean") * F.col("present")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("present")))
    own = parts.groupBy("place", "column", "dtype").agg(
        F.sum("rows").alias("rows"), n.alias("present"), mean.alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.sum("squares").alias("inside"), F.when(F.count("distinct") > 0, F.hll_sketch_estimate(F.hll_union_agg("distinct"))).alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"),
    )
    # Deviations of the parts' means from the mean of all: few rows, joined back by column.
    between = parts.join(F.broadcast(own.select("place", F.col("mean").alias("_all"))), "place").groupBy("place").agg(F.sum(F.col("present") * (F.col("mean") - F.col("_all")) ** 2).alias("between"))
    q = [F.when((F.col("mean").isNotNull()) & (F.kll_sketch_get_n_double("ranks") > 0), F.kll_sketch_get_quantile_double("ranks", F.lit(p))) for p in quantiles]
    std = F.when(F.col("present") > 1, F.sqrt((F.col("inside") + F.col("between")) / (F.col("present") - 1)))
    out = own.join(between, "place")
    return out.select("column", "dtype", ((1 - F.col("present") / F.col("rows")) * 100).alias("missing_pct"), "distinct", "mean", std.alias("std"), "min", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), "max")


def suggestions(profile: DataFrame) -> DataFrame:
    """(suggestion): what a profile's columns allow."""
    is_number = F.col("dtype").rlike("int|double|float|decimal")
    found = profile.agg(F.sum(is_number.cast("int")).alias("n"), F.max((F.col("dtype").isin("string", "boolean")).cast("int")).alias("o"), F.max(F.col("dtype").rlike("timestamp|date").cast("int")).alias("t"), F.max("missing_pct").alias("m"))
    items = [F.when(F.col("n") >= 2, "correlation, outliers, models"), F.when(F.col("o") > 0, "category counts, groups, encoding"), F.when(F.col("t") > 0, "trends, seasons, forecasts"), F.when(F.col("m") > 0, "fill or drop missing values")]
    kept = F.filter(F.array(*items), lambda x: x.isNotNull())
    return found.select(F.explode(F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("clean and standardise first")))).alias("suggestion"))
