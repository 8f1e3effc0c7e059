"""Column expressions on sensor arrays; null and non-finite values count as stated at each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAULTS = ("sd", "isc", "conn", "samp", "ins")


def finite(x: Column) -> Column:
    """x as double; null, NaN and infinities as 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def finite_array(a: Column) -> Column:
    """Items as doubles, null, NaN and infinities as 0.  Most arrays have none of these and pass as they are."""
    no_null = F.array_contains(a, F.lit(float("inf"))).isNotNull()  # null where an item is, as no item is infinite here; compiled, unlike a function of items
    clean = (F.array_max(a) < float("inf")) & (F.array_min(a) > float("-inf")) & no_null
    return F.when(clean, a.cast("array<double>")).otherwise(F.transform(a, finite))


def parse_series(text: Column) -> Column:
    """``a~b~c`` as doubles; empty items are dropped, items that are no finite number are 0.  Null gives one 0."""
    items = F.filter(F.split(text, "~"), lambda x: x != "")
    numbers = F.transform(items, lambda x: x.try_cast("double"))  # on its own: in ``finite`` each item would be parsed four times
    return F.when(text.isNull(), F.array(F.lit(0.0))).otherwise(F.transform(numbers, finite))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_median(a: Column) -> Column:
    """Median of a non-empty array of doubles; null for an empty one."""
    n = F.size(a)
    middle = lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, F.transform(F.array(F.array_sort(a)), middle)[0])


def array_range(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def argmin(a: Column) -> Column:
    """Index (from 0) of the first smallest item."""
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def neighbour_gap(a: Column) -> Column:
    """Largest absolute difference of two neighbouring items; 0 with fewer than two."""
    steps = F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.abs(y - x))
    return F.coalesce(F.array_max(steps), F.lit(0.0))


#: Width of each module of a pack of 92 cells, in order; its 34 probes stand in pairs.
PACK_CELLS = (5,) * 10 + (6,) * 7
PACK_PROBES = (2,) * 17


def _in_order(widths) -> list[tuple[int, int]]:
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def module_groups(total: int, groups: int) -> list[tuple[int, int]]:
    """(start, length) of contiguous groups of near-equal length, the longer ones first."""
    groups = max(1, min(groups, total))
    return _in_order([total // groups + (k < total % groups) for k in range(groups)])


def pack_modules(cells: int, probes: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Groups of cells and of probes, module by module.

    A pack of 92 cells and one of 34 probes have their fixed groups, whatever the number of the others; else there
    are as many groups of cells as probes (17 beside 34 probes), and as many groups of probes as of cells.
    """
    by_cell = _in_order(PACK_CELLS) if cells == 92 else module_groups(cells, 17 if probes == 34 else probes)
    by_probe = _in_order(PACK_PROBES) if probes == 34 else module_groups(probes, len(by_cell))
    count = min(len(by_cell), len(by_probe))
    return by_cell[:count], by_probe[:count]


def module_values(a: Column, groups: list[tuple[int, int]], least: bool) -> Column:
    """Smallest (or largest) item of each group of sensors."""
    pick = F.array_min if least else F.array_max
    places = F.array(*(F.struct(F.lit(start + 1).alias("first"), F.lit(width).alias("width")) for start, width in groups))
    return F.transform(places, lambda g: pick(F.slice(a, g["first"], g["width"])))  # one small expression for all groups; written out, the generated code gets too long to be compiled
