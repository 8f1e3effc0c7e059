"""Splits by classes of faults, held against loops over all subsets and over all deals of classes."""

import itertools
import random
from functools import reduce

import pytest

from fleetlens.operators import covers, splits

from test_windows_and_splits import naive_assign, profile

RULES = ["train_plus_eval", "eval_only"]


def cover_key(rows, split):
    """What the search ranks first: full covers of test, val and train, rare faults, faults in train."""
    bits = {v: [int(x) for x in vec.split("|")] for v, vec in rows}
    has = lambda sides, k: any(bits[v][k] for v, s in split.items() if s in sides)
    full = lambda s: all(has((s,), k) for k in (0, 3, 4))
    out = [full("test"), full("val"), full("train"), full("test"), full("val")]
    have = [sum(b[k] for b in bits.values()) for k in (1, 2)]
    if have[0]:
        in_eval, in_train = has(("test", "val"), 1), has(("train",), 1)
        out += [have[0] >= 2 and in_train and in_eval, in_train, in_eval]
    if have[1]:
        out.append(has(("test", "val"), 2))
    return (*out, sum(has(("train",), k) for k in (0, 3, 4)))


def by_classes(spark, rows, sizes):
    vehicles = splits._vehicles(profile(spark, rows), splits.CORE)
    named = dict(zip(("train", "val", "test"), sizes))
    got = covers.cover_splits(vehicles, named, 7, ["rare_isc", "rare_conn"], RULES).collect()
    assert {s: sum(r.split == s for r in got) for s in named} == named and len({r.id for r in got}) == len(rows)
    return {r.id: r.split for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_cover_equals_the_search(spark, seed):
    rng = random.Random(seed)
    n, sizes = [(9, (3, 3, 3)), (8, (4, 2, 2)), (10, (5, 3, 2)), (20, (16, 2, 2))][seed]
    rows = [(f"v{k:02d}", "|".join(str(int(rng.random() < p)) for p in (0.3, 0.15, 0.1, 0.35, 0.3))) for k in range(n)]
    want = naive_assign(rows, sizes, None if n < 20 else 800)
    assert cover_key(rows, by_classes(spark, rows, sizes)) == cover_key(rows, want)


@pytest.mark.parametrize("seed", range(30))
def test_witnesses_against_all_deals(seed):
    """Every way to deal seven vehicles to three splits of given sizes."""
    rng = random.Random(seed)
    kinds = [tuple(rng.randrange(8) & rng.randrange(8) for _ in range(2)) + (rng.randrange(4) & rng.randrange(4),) for _ in range(4)]
    fleet = sorted(rng.choice(kinds) for _ in range(7))
    sizes = {"test": 2, "val": 2, "train": 3}
    have = [sum(c[2] >> k & 1 for c in fleet) for k in (0, 1)]

    def key(deal):
        side = lambda names, part: [c[part] for c, s in zip(fleet, deal) if s in names]
        join = lambda values: reduce(int.__or__, values, 0)
        i = {s: join(side((s,), 0)) for s in sizes}
        w = {s: join(side((s,), 1)) for s in sizes}
        in_eval, in_train = join(side(("test", "val"), 2)), join(side(("train",), 2))
        out = [i["test"] == 7, i["val"] == 7, i["train"] == 7, w["test"] == 7, w["val"] == 7]
        if have[0]:
            out += [have[0] >= 2 and bool(in_eval & in_train & 1), bool(in_train & 1), bool(in_eval & 1)]
        if have[1]:
            out.append(bool(in_eval & 2))
        return (*out, i["train"].bit_count())

    best = max(map(key, _deals(7)))
    got = covers.best_witnesses({c: fleet.count(c) for c in set(fleet)}, sizes, 7, RULES)
    free, deal = list(range(7)), [None] * 7
    for c, s in got:
        at = next(k for k in free if fleet[k] == c)
        free.remove(at)
        deal[at] = s
    for s in sizes:
        while deal.count(s) < sizes[s]:
            deal[free.pop()] = s
    assert key(deal) == best


def _deals(n):
    for t in itertools.combinations(range(n), 2):
        for v in itertools.combinations([k for k in range(n) if k not in t], 2):
            yield tuple("test" if k in t else "val" if k in v else "train" for k in range(n))


def test_large_fleet_covers(spark):
    """400 vehicles, of which three hold all core faults and one each of two rare kinds: every split gets its own."""
    rows = [(f"v{k:03d}", "0|0|0|0|0") for k in range(400)]
    for at, vec in ((7, "1|0|0|1|1"), (150, "1|0|0|1|1"), (399, "1|1|0|1|1"), (20, "0|1|0|0|0"), (30, "0|0|1|0|0")):
        rows[at] = (rows[at][0], vec)
    got = {r.vehicle_id: r.split for r in splits.assign_splits(profile(spark, rows), 300, 60, 40).collect()}
    assert sorted(got[v] for v in ("v007", "v150", "v399")) == ["test", "train", "val"]
    assert cover_key(rows, got) == (True,) * 9 + (3,)


def test_one_class_and_no_faults(spark):
    rows = [(f"v{k:02d}", "1|0|0|1|1") for k in range(35)]
    assert cover_key(rows, by_classes(spark, rows, (25, 5, 5)))[:3] == (True,) * 3
    rows = [(f"v{k:02d}", "0|0|0|0|0") for k in range(35)]
    assert len(by_classes(spark, rows, (33, 1, 1))) == 35
