"""Vehicle splits, sampling under constraints, and checks of both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sensors import FAULTS
from ..sources.shared import shared_dir
from .clean import KEY
from .covers import SPLITS, cover_splits

CORE = ("sd", "samp", "ins")
#: What a rare fault's positives have to reach.
RARE = {"isc": "train_plus_eval", "conn": "eval_only"}
#: Vehicles up to which all subsets can be searched.
SEARCH_LIMIT = 30
BEST = 800


def _mask(profile: str, core) -> Column:
    order = list(FAULTS)
    parts = F.split(profile, r"\|")
    return reduce(lambda a, b: a + b, (F.when(F.get(parts, F.lit(order.index(f))) != "0", F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(core)))


def _vehicles(profile: DataFrame, core) -> DataFrame:
    rare = {f"rare_{f}": (F.get(F.split("fault_vector", r"\|"), F.lit(FAULTS.index(f))) != "0").cast("int") for f in RARE}
    total = lambda k: reduce(lambda a, b: a + b, (F.coalesce(F.col(f"y_{k}_{f}_positive"), F.lit(0)).cast("long") for f in core))
    return profile.select(F.col(KEY).alias("id"), F.col("window_count").cast("long").alias("windows"), _mask("fault_vector", core).alias("id_mask"), _mask("warning_fault_vector", core).alias("warn_mask"), total("id").alias("id_total"), total("warn").alias("warn_total"), *(c.alias(k) for k, c in rare.items()))


def _subsets(vehicles: DataFrame, size: int, full: int, best: int) -> DataFrame:
    """The ``best`` subsets of ``size`` vehicles: theta joins that only go up in id, ordered by cover and counts."""
    sums = ["windows", "id_total", "warn_total"]
    bits = ["id_mask", "warn_mask", *(f"rare_{f}" for f in RARE)]
    out = vehicles.select(F.array("id").alias("ids"), *sums, *bits)
    for _ in range(size - 1):
        more = vehicles.select(F.col("id").alias("id2"), *(F.col(c).alias(f"{c}2") for c in sums + bits))
        out = out.join(more, F.element_at("ids", -1) < F.col("id2")).select(F.concat("ids", F.array("id2")).alias("ids"), *((F.col(c) + F.col(f"{c}2")).alias(c) for c in sums), *(F.col(c).bitwiseOR(F.col(f"{c}2")).alias(c) for c in bits))
    hits = reduce(lambda a, b: a + b, (F.col(f"rare_{f}") for f in RARE))
    key = [-(F.col("id_mask") == full).cast("int"), -(F.col("warn_mask") == full).cast("int"), -F.bit_count("id_mask"), -F.bit_count("warn_mask"), -hits, -F.col("id_total"), -F.col("warn_total"), -F.col("windows"), F.col("ids")]
    return out.orderBy(*key).limit(best)


def assign_splits(profile: DataFrame, train: int = 12, val: int = 4, test: int = 4, core=CORE) -> DataFrame:
    """(vehicle_id, split) for a window profile of ``train + val + test`` vehicles, so that every split covers the core faults as far as can be.

    Up to ``SEARCH_LIMIT`` vehicles the best disjoint pair of test and validation subsets is searched, by cover, rare faults, counts and
    ids in turn.  Larger fleets go by classes of equal faults (``covers.cover_splits``): the cover is the best possible as well, counts
    are those of filling up with the vehicles of most warnings.
    """
    shared_dir(profile.sparkSession)  # checkpoints need a folder
    vehicles = _vehicles(profile, core).checkpoint()
    n = vehicles.count()
    if n != train + val + test:
        raise ValueError("the counts do not add up to the number of vehicles")
    full = (1 << len(core)) - 1
    if n > SEARCH_LIMIT:
        placed = cover_splits(vehicles, {"test": test, "val": val, "train": train}, full, [f"rare_{f}" for f in RARE], list(RARE.values()))
        return placed.withColumnRenamed("id", KEY)
    best = BEST if n >= 20 else 1 << 30
    rare = [f"rare_{f}" for f in RARE]
    names = ["ids", "windows", "id_total", "warn_total", "id_mask", "warn_mask", *rare]
    side = lambda size, mark: _subsets(vehicles, size, full, best).select(*(F.col(c).alias(f"{mark}_{c}") for c in names))
    pairs = side(test, "t").join(side(val, "v"), ~F.arrays_overlap("t_ids", "v_ids")).withColumn("_pair", F.monotonically_increasing_id()).checkpoint()
    rest = pairs.select("_pair", "t_ids", "v_ids").join(vehicles, ~F.array_contains("t_ids", F.col("id")) & ~F.array_contains("v_ids", F.col("id")), "left")
    rest = rest.groupBy("_pair").agg(F.bit_or("id_mask").alias("r_id_mask"), F.sum("id_total").alias("r_id_total"), *(F.max(c).alias(f"r_{c}") for c in rare))
    counts = vehicles.agg(*(F.sum(c).alias(c) for c in rare)).first()
    key = [F.col(f"{s}_id_mask") == full for s in ("t", "v", "r")] + [F.col(f"{s}_warn_mask") == full for s in ("t", "v")]
    for f, rule in RARE.items():
        have = counts[f"rare_{f}"] or 0
        in_eval = F.greatest(f"t_rare_{f}", f"v_rare_{f}") > 0
        in_train = F.coalesce(F.col(f"r_rare_{f}"), F.lit(0)) > 0
        if have and rule == "train_plus_eval":
            key += [F.lit(have >= 2) & in_train & in_eval, in_train, in_eval]
        elif have:
            key.append(in_eval)
    order = [-k.cast("int") for k in key] + [-F.bit_count("r_id_mask"), -(F.col("t_id_total") + F.col("v_id_total") + F.col("r_id_total")), -(F.col("t_warn_total") + F.col("v_warn_total")), -(F.col("t_windows") + F.col("v_windows")), F.col("t_ids"), F.col("v_ids")]
    chosen = pairs.join(rest, "_pair").orderBy(*order).limit(1)
    placed = chosen.select(F.explode("t_ids").alias(KEY), F.lit("test").alias("split")).unionByName(chosen.select(F.explode("v_ids").alias(KEY), F.lit("val").alias("split")))
    return profile.select(KEY).join(placed, KEY, "left").select(KEY, F.coalesce("split", F.lit("train")).alias("split"))


def greedy_splits(profile: DataFrame, val: int, test: int, core=CORE) -> DataFrame:
    """(vehicle_id, split): vehicles ranked by faults covered, positives, windows and id; ranks are dealt to test, val and train in turn until val and test are full."""
    v = _vehicles(profile, core)
    rank = F.row_number().over(Window.orderBy(-F.bit_count("id_mask"), -F.bit_count("warn_mask"), -F.col("id_total"), -F.col("windows"), "id")) - 1
    turn, kind = F.floor(F.col("_r") / 3), F.col("_r") % 3
    split = F.when((kind == 0) & (turn < test), "test").when((kind == 1) & (turn < val), "val").otherwise("train")
    return v.withColumn("_r", rank).select(F.col("id").alias(KEY), split.alias("split"))


def draw_order(seed: int, column: str) -> Column:
    """The seeded order of draws: a digest of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column)).cast("binary"))


def random_splits(vehicles: DataFrame, val: int, test: int, seed: int = 42) -> DataFrame:
    """(vehicle_id, split): vehicles in seeded order; the first go to test, the next to val, the rest to train."""
    ids = vehicles.select(KEY).distinct()
    drawn = _first_drawn(ids.withColumn("_take", F.lit(test + val)), [], KEY, seed)
    rank = F.row_number().over(Window.orderBy("_draw", KEY))
    first = drawn.withColumn("_r", rank).select(KEY, F.when(F.col("_r") <= test, "test").otherwise("val").alias("split"))
    return ids.join(first, KEY, "left").select(KEY, F.coalesce("split", F.lit("train")).alias("split"))


def _first_drawn(rows: DataFrame, keys: list[str], column: str, seed: int) -> DataFrame:
    """Of each group the first ``_take`` rows in seeded order of ``column``; adds _draw.

    Rows are counted by the first digits of their digest: whole digits go in or stay out, and only rows of the one in between are put in order.
    """
    rows = rows.withColumn("_draw", draw_order(seed, column)).withColumn("_digits", F.substring("_draw", 1, 3))
    group = Window.partitionBy(*keys).orderBy("_digits")
    counts = rows.groupBy(*keys, "_digits").agg(F.count("*").alias("_rows"), F.max("_take").alias("_most"))
    counts = counts.withColumn("_left", F.col("_most") - F.sum("_rows").over(group) + F.col("_rows")).where("_left > 0").drop("_most")
    rows = rows.join(counts, [*keys, "_digits"])
    whole, part = rows.where("_left >= _rows"), rows.where("_left < _rows")
    place = F.row_number().over(Window.partitionBy(*keys, "_digits").orderBy("_draw", column))
    return whole.unionByName(part.withColumn("_n", place).where("_n <= _left").drop("_n")).drop("_digits", "_rows", "_left", "_take")


def positive(faults=FAULTS) -> Column:
    return reduce(lambda a, b: a | b, (F.col(f"y_{k}_{f}") == 1 for k in ("id", "warn") for f in faults))


def downsample(samples: DataFrame, split: str, target: int, seed: int = 42, faults=FAULTS) -> DataFrame:
    """Rows of one split: all positives, and negatives up to ``target`` in all.

    Negatives are shared out to vehicles by largest remainder (of equal ones the higher id first) and drawn in seeded order.
    """
    own = samples.where(F.col("split") == split)
    pos, neg = own.where(positive(faults)), own.where(~positive(faults))
    sizes = neg.groupBy(KEY).agg(F.count("*").alias("size"))
    whole = sizes.agg(F.sum("size").alias("total")).crossJoin(pos.agg(F.count("*").alias("taken")))
    share = F.least(F.greatest(F.lit(target) - F.col("taken"), F.lit(0)), F.col("total")) * F.col("size") / F.col("total")
    sizes = sizes.crossJoin(F.broadcast(whole)).withColumn("_share", share).withColumn("_base", F.floor("_share"))
    left = F.least(F.greatest(F.lit(target) - F.col("taken"), F.lit(0)), F.col("total")) - F.sum("_base").over(Window.partitionBy())
    order = F.row_number().over(Window.orderBy(F.desc(F.col("_share") - F.col("_base")), F.desc(KEY)))
    take = sizes.withColumns({"_left": left, "_order": order}).select(KEY, (F.col("_base") + (F.col("_order") <= F.col("_left")).cast("int")).alias("_take"))
    chosen = _first_drawn(neg.join(take, KEY), [KEY], "sample_id", seed)
    return pos.unionByName(chosen.select(*pos.columns))


def cap(samples: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each split, in seeded order."""
    return _first_drawn(samples.withColumn("_take", F.lit(most)), ["split"], "sample_id", seed).select(*samples.columns)


def medium_bundle(*parts: DataFrame) -> DataFrame:
    """The union of sample tables, each sample once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).dropDuplicates(["sample_id"])


def split_summary(samples: DataFrame, faults=FAULTS) -> DataFrame:
    """By split: samples and positives of every target."""
    return samples.groupBy("split").agg(F.count("*").alias("sample_count"), *(F.sum(f"y_{k}_{f}").alias(f"y_{k}_{f}") for k in ("id", "warn") for f in faults))


def split_vehicle_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split", KEY).agg(F.count("*").alias("sample_count"))


def coverage_issues(summary: DataFrame, faults=CORE, rare=RARE) -> DataFrame:
    """(level, code): a core target without positives in a split blocks; a rare one is a note."""
    targets = [f"y_{k}_{f}" for k in ("id", "warn") for f in (*faults, *rare)]
    long = summary.unpivot(["split"], targets, "target", "n").where("coalesce(n, 0) <= 0")
    is_rare = reduce(lambda a, b: a | b, (F.col("target").endswith(f"_{f}") for f in rare), F.lit(False))
    return long.select(F.when(is_rare, "note").otherwise("blocking").alias("level"), F.concat_ws(":", "split", "target").alias("code"))


def consistency_issues(samples: DataFrame, mapping: DataFrame) -> DataFrame:
    """(issue, vehicle_id, detail): vehicles in several splits, missing on a side, or mapped to another split than their samples."""
    mine = samples.groupBy(KEY).agg(F.array_sort(F.collect_set("split")).alias("splits"))
    both = mine.join(mapping.select(KEY, F.col("split").alias("mapped")), KEY, "full_outer")
    issue = (
        F.when(F.size("splits") > 1, "several_splits").when(F.col("splits").isNull(), "missing_in_samples").when(F.col("mapped").isNull(), "missing_in_mapping")
        .when(F.col("splits")[0] != F.col("mapped"), "split_mismatch")
    )
    return both.select(issue.alias("issue"), KEY, F.concat_ws(",", F.coalesce("splits", F.array("mapped"))).alias("detail")).where("issue is not null")


def external_pool(samples: DataFrame, raw_vehicles: DataFrame) -> DataFrame:
    """Samples of raw vehicles only, as split external_test."""
    return samples.join(raw_vehicles.select(KEY).distinct(), KEY, "left_semi").withColumn("split", F.lit("external_test"))


def with_splits(samples: DataFrame, mapping: DataFrame, missing: str = "external_test") -> DataFrame:
    """Samples with their vehicle's split; vehicles that the map lacks get ``missing``."""
    return samples.join(mapping.select(KEY, F.col("split").alias("_split")), KEY, "left").withColumn("split", F.coalesce("_split", F.lit(missing))).drop("_split")
