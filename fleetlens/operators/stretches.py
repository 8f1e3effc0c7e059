"""Steps along a vehicle's rows by stretches of frames, so that one long vehicle spreads over many tasks.

A stretch is ``STRETCH`` numbers of ``frame_index``, which numbers a vehicle's rows without gaps.  What a row needs of others is one of two things.
A few rows around it: ``with_halo`` gives each stretch the rows around it too.  Or something that all earlier (or later) rows decide,
such as a count, the last known value or the state of a rule: ``carried`` sums up each stretch, combines these sums over the stretches of a vehicle (a row
a stretch) and gives every row what the stretches before and after its own come to; the rest is a window ``inside`` the stretch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORDER = "vehicle_id", "frame_index"
STRETCH = 4096


def with_halo(df: DataFrame, before: int, after: int, chunk: int | None = None, order: str = ORDER) -> DataFrame:
    """Rows of each vehicle in chunks of ``chunk`` frames, each with the rows around it: adds _chunk and _core.

    Row frames that reach at most ``before`` rows back and ``after`` rows on give the same result
    over (vehicle, _chunk) as over the vehicle, for rows with _core; so one long vehicle spreads over many tasks.
    """
    chunk = chunk or STRETCH
    own = F.floor(F.col(order) / chunk)
    first, last = F.floor((F.col(order) - after) / chunk), F.floor((F.col(order) + before) / chunk)
    chunks = F.sequence(F.greatest(first, F.lit(0)), last)
    return df.withColumn("_chunk", F.explode(chunks)).withColumn("_core", F.col("_chunk") == own)


def in_stretches(df: DataFrame, order: str = ORDER, chunk: int | None = None) -> DataFrame:
    """Adds _chunk, the number of the row's stretch."""
    return df.withColumn("_chunk", F.floor(F.col(order) / (chunk or STRETCH)))


def inside(key: str = KEY, order: str = ORDER, descending: bool = False) -> WindowSpec:
    return Window.partitionBy(key, "_chunk").orderBy(F.desc(order) if descending else order)


Fold = Callable[[WindowSpec], Column]


def carried(df: DataFrame, parts: dict[str, Column], before: dict[str, Fold] | None = None, after: dict[str, Fold] | None = None, whole: dict[str, Fold] | None = None, key: str = KEY, of: DataFrame | None = None) -> DataFrame:
    """``df`` (with _chunk) and what other stretches come to.

    ``parts`` sums up the rows of a stretch; ``before`` and ``after`` combine the parts of the stretches on that side (in both, the nearest stretch comes last), ``whole``
    those of all.  Without stretches on a side the result is what the function gives for no rows.  The parts may come from ``of``, which has the
    rows and columns they need.
    """
    sums = (df if of is None else of).groupBy(key, "_chunk").agg(*(c.alias(f"_{n}") for n, c in parts.items()))
    by = Window.partitionBy(key)
    sides = {}
    for fold, side in ((before, by.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), (after, by.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)), (whole, by)):
        sides |= {n: f(side).alias(n) for n, f in (fold or {}).items()}
    return df.join(sums.select(key, "_chunk", *sides.values()), [key, "_chunk"])
