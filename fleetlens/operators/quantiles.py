"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stretches


def value_range(x: Column) -> Column:
    """A whole number that never falls as x rises: 256 ranges to each power of two, on either side of 0; NaN counts as the largest."""
    size = F.floor(F.log2(F.abs(x)) * 256) + (1 << 19)
    ends = F.when(F.isnan(x) | (x == float("inf")), F.lit(1 << 30)).when(x == float("-inf"), F.lit(-(1 << 30)))
    return ends.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("long")


def grouped_quantiles(values: DataFrame, keys: list[str], column: str, shares: tuple[float, ...]) -> DataFrame:
    """(keys, q): for each group an array of the quantiles at ``shares``, linear between neighbours; nulls are left out.

    Rows are counted by range of value, combined in the tasks; that tells in which ranges the ranks asked for lie. Only the distinct
    values of these ranges are then counted and put in order, so no task holds a group.
    """
    rows = values.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_x"), value_range(F.col(column)).alias("_range"))
    ranges = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    group = Window.partitionBy(*keys)
    ranges = ranges.withColumns({"_from": F.sum("_rows").over(group.orderBy("_range")) - F.col("_rows"), "_n": F.sum("_rows").over(group)})
    place = [F.lit(s) * (F.col("_n") - 1) for s in shares]
    holds = lambda p: (p >= F.col("_from")) & (p < F.col("_from") + F.col("_rows"))
    wanted = F.lit(False)
    for p in place:
        wanted = wanted | holds(F.floor(p)) | holds(F.ceil(p))
    inside = rows.join(ranges.where(wanted).select(*keys, "_range", "_from", "_n"), [*keys, "_range"])
    inside = inside.groupBy(*keys, "_range", "_x").agg(F.first("_from").alias("_from"), F.first("_n").alias("_n"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys, "_range").orderBy("_x")) - F.col("_rows")
    inside = inside.withColumn("_from", F.col("_from") + before)
    low = [F.max(F.when(holds(F.floor(p)), F.col("_x"))) for p in place]
    high = [F.max(F.when(holds(F.ceil(p)), F.col("_x"))) for p in place]
    part = [F.max(p - F.floor(p)) for p in place]
    return inside.groupBy(*keys).agg(F.array(*(a + (b - a) * t for a, b, t in zip(low, high, part))).alias("q"))


def _at_shares(values: Column, shares: tuple[float, ...]) -> Column:
    """Quantiles of an array without nulls, linear between neighbours; null for an empty one."""

    def quantile(x: Column, share: float) -> Column:
        place = F.lit(share) * (F.size(x) - 1)
        low, high = F.get(x, F.floor(place).cast("int")), F.get(x, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    each = F.transform(F.array(F.sort_array(values)), lambda x: F.array(*(quantile(x, s) for s in shares)))[0]
    return F.when(F.size(values) > 0, each)


def array_quantiles(rows: DataFrame, key: str, column: str, shares: tuple[float, ...], by_place: bool = False, zeros: bool = True, lengths: DataFrame | None = None) -> DataFrame:
    """(key, q), or with ``by_place`` (key, cell, q): quantiles of the items of an array column by group, or by group and place in the array; nulls (without ``zeros`` zeros too) are left out.

    A group of at most ``stretches.STRETCH`` rows is put in order as a whole; the items of longer groups go by ranges of value (``grouped_quantiles``).  Both are exact.
    ``lengths`` may give (key, _rows), at least the rows of each group; else they are counted.
    """
    lengths = rows.groupBy(key).agg(F.count("*").alias("_rows")) if lengths is None else lengths
    long = lengths.where(F.col("_rows") > stretches.STRETCH).select(key)
    wanted = lambda x: x.isNotNull() if zeros else x != 0
    some = not long.isEmpty()
    short = rows.join(long, key, "left_anti") if some else rows
    short = short.groupBy(key).agg(F.collect_list(column).alias("_rows"), F.max(F.size(column)).alias("_size"))
    if by_place:
        item = lambda i: F.filter(F.transform("_rows", lambda r: F.get(r, i)), wanted)
        each = F.transform(F.sequence(F.lit(0), F.col("_size") - 1), lambda i: _at_shares(item(i), shares))
        out = short.where("_size > 0").select(key, F.posexplode(each).alias("cell", "q"))
    else:
        out = short.select(key, _at_shares(F.filter(F.flatten("_rows"), wanted), shares).alias("q"))
    out = out.where("q is not null")
    if not some:
        return out
    items = rows.join(long, key, "left_semi").select(key, F.posexplode(column).alias("cell", "_item")).where(wanted(F.col("_item")))
    return out.unionByName(grouped_quantiles(items, [key, "cell"] if by_place else [key], "_item", shares))
