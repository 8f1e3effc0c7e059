"""Splits of fleets of any size that cover faults as well as can be, by classes of vehicles with the same faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("test", "val", "train")


def best_witnesses(classes: dict[tuple[int, int, int], int], sizes: dict[str, int], full: int, rules: list[str]) -> list[tuple[tuple[int, int, int], str]]:
    """(class, split) pairs, a vehicle each, whose faults give the best cover that disjoint splits of these sizes can have.

    A class is (identified faults, warned faults, rare faults) as bits, with its number of vehicles.  A further vehicle never takes cover
    away, and a second of one class adds none to the same split.  So the best cover is found by going through the classes once, each
    giving at most one vehicle to each split, and keeping for every cover reached the least numbers of vehicles used.  A class whose
    faults another of three or more vehicles has as well is left out: that one can stand in for it in every split.
    """
    inside = lambda c, d: all(a & b == a for a, b in zip(c, d))
    kept = sorted(c for c in classes if not any(d != c and classes[d] >= 3 and inside(c, d) for d in classes))
    have = [sum(n for c, n in classes.items() if c[2] >> k & 1) for k in range(len(rules))]

    # A state: faults identified and warned in test and in val, identified in train, rare ones in test or val, rare ones in train.
    reached = {(0, 0, 0, 0, 0, 0, 0): [((0, 0, 0), ())]}
    for c in kept:
        found, warned, rare = c
        more = {s: list(w) for s, w in reached.items()}
        for (ti, tw, vi, vw, ri, er, rr), ways in reached.items():
            for pick in range(1, 8):
                t, v, r = pick & 1, pick >> 1 & 1, pick >> 2
                if t + v + r > classes[c]:
                    continue
                state = (ti | found * t, tw | warned * t, vi | found * v, vw | warned * v, ri | found * r, er | rare * (t | v), rr | rare * r)
                if state == (ti, tw, vi, vw, ri, er, rr):
                    continue
                for (a, b, e), chosen in ways:
                    used = (a + t, b + v, e + r)
                    if all(u <= sizes[s] for u, s in zip(used, SPLITS)):
                        _keep(more.setdefault(state, []), used, (*chosen, *((c, s) for s, p in zip(SPLITS, (t, v, r)) if p)))
        reached = {s: w for s, w in more.items() if w}

    def rank(state):
        ti, tw, vi, vw, ri, er, rr = state
        key = [ti == full, vi == full, ri == full, tw == full, vw == full]
        for k, rule in enumerate(rules):
            in_eval, in_train = bool(er >> k & 1), bool(rr >> k & 1)
            if have[k] and rule == "train_plus_eval":
                key += [have[k] >= 2 and in_train and in_eval, in_train, in_eval]
            elif have[k]:
                key.append(in_eval)
        return (*key, ri.bit_count())

    top = max(map(rank, reached))
    return list(min((sum(used), chosen) for s, ways in reached.items() if rank(s) == top for used, chosen in ways)[1])


def _keep(ways: list, used: tuple[int, int, int], chosen: tuple) -> None:
    """Adds a way unless another uses no more vehicles in any split; drops those it makes needless."""
    if any(all(x <= y for x, y in zip(other, used)) for other, _ in ways):
        return
    ways[:] = [w for w in ways if not all(x <= y for x, y in zip(used, w[0]))]
    ways.append((used, chosen))


def cover_splits(vehicles: DataFrame, sizes: dict[str, int], full: int, rare: list[str], rules: list[str]) -> DataFrame:
    """(id, split) for vehicles (id, id_mask, warn_mask, warn_total, windows, and 0 or 1 in each column of ``rare``).

    Only the counts of the classes, of which there are as many as sets of faults, come to the driver.  Test and val take their
    witnesses from a class's vehicles of most warnings, train from those of fewest (then windows, then id); the rest of test, then of
    val is filled with the vehicles left of most warnings.  So the cover is the best possible; the totals are those of this filling.
    """
    bits: Column = sum((F.col(c).cast("int") * (1 << k) for k, c in enumerate(rare)), F.lit(0))
    vehicles = vehicles.withColumn("_class", F.struct(F.col("id_mask").alias("a"), F.col("warn_mask").alias("b"), bits.alias("c")))
    counts = {tuple(r[0]): r[1] for r in vehicles.groupBy("_class").agg(F.count("*")).collect()}
    chosen = best_witnesses(counts, sizes, full, rules)
    order = [-F.col("warn_total"), -F.col("windows"), F.col("id")]
    places, taken = [], {}
    for s in SPLITS:
        for c in [c for c, split in chosen if split == s]:
            place = 1 if s == "train" else taken.get(c, 0) + 1
            taken[c] = place if s != "train" else taken.get(c, 0)
            places.append((*c, place, s == "train", s))
    wanted = vehicles.sparkSession.createDataFrame(places, "a int, b int, c int, _place int, _last boolean, split string")
    wanted = wanted.select(F.struct("a", "b", "c").alias("_class"), "_place", "_last", "split")
    # A class may hold the whole fleet: its first two and its last vehicle are kept a partition before anything is shuffled.
    ends = lambda by, last, most: vehicles.withColumn("_place", F.row_number().over(Window.partitionBy("_class").orderBy(*by))).where(F.col("_place") <= most).withColumn("_last", F.lit(last))
    reverse = [F.col("warn_total"), F.col("windows"), F.desc("id")]
    cast = F.struct(*(F.col(f"_class.{k}").cast("int").alias(k) for k in "abc"))
    both = ends(order, False, 2).unionByName(ends(reverse, True, 1)).withColumn("_class", cast)
    witnesses = both.join(F.broadcast(wanted), ["_class", "_place", "_last"]).select("id", "split")
    used = {s: sum(split == s for _, split in chosen) for s in SPLITS}
    test, val = (sizes[s] - used[s] for s in ("test", "val"))
    left = vehicles.join(witnesses, "id", "left_anti").orderBy(*order).limit(test + val)
    place = F.row_number().over(Window.orderBy(*order))  # of test's and val's vehicles, not of the fleet
    filled = left.select("id", F.when(place <= test, "test").otherwise("val").alias("split"))
    placed = witnesses.unionByName(filled)
    return vehicles.select("id").join(placed, "id", "left").select("id", F.coalesce("split", F.lit("train")).alias("split"))
