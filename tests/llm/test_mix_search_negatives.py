"""Small fixtures against brute force for the mix of sources, ranked search and hard negatives."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import hard_negatives, lexical_search, mixing
from fleetlens.llm.shared import Scratch

WORDS = "the of and to in is was for on that with as by at from his her it an were are which this be or had".split() + [f"w{i}" for i in range(200)]


def clashing(df, *names):
    """Columns whose names clash with what operators add."""
    return df.withColumns({c: F.lit("own") for c in names})


# the mix

MIX_ROWS = [(k, " ".join(f"w{k}_{i}" for i in range(random.Random(k).randrange(0, 90))), f"s{k % 4}" if k % 3 else "s0") for k in range(90)]
MIX_ODD = [(None, "a b c", "s1"), (None, "a b c", "s1"), (500, None, "s2"), (501, "", None), (502, " \n\t ", "none"), (503, "x y", None), (503, "x y", None), (504, "one " * 3000, "s3"), (505, "é　z\x0bq", "Z")]


def mix_table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return clashing(df, "size", "row", "start", "index", "number", "target", "words", "_part", "taken").repartition(5)


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size_of(text)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        left, free = left - sum(2 * sizes[s] for s in over), free - over
    return sizes, out


def test_mix_report(spark):
    rows = MIX_ROWS + MIX_ODD
    got = mixing.mix_report(mix_table(spark, rows), block=16, shard=40).collect()
    again = mixing.mix_report(mix_table(spark, rows[::-1]), block=16, shard=40).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, wanted = targets(rows)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(d), size_of(t)) for d, t, _ in rows)
    assert all(0 <= r.taken <= 2 * r["size"] and (r["size"] or not r.taken) for r in got)
    for source, size in sizes.items():
        own = [r for r in got if r.source == source]
        assert all(r.source_size == size and math.isclose(r.target, wanted[source], abs_tol=1e-6) for r in own)
        assert abs(sum(r.taken for r in own) - wanted[source]) <= 0.06 * wanted[source] + 40


def test_the_mix_itself_has_the_words_of_the_report(spark):
    rows = MIX_ROWS + MIX_ODD
    got = mixing.mix(mix_table(spark, rows), block=16, shard=40).collect()
    report = mixing.mix_report(mix_table(spark, rows), block=16, shard=40)
    taken = Counter()
    for r in got:
        words = r.text.split(" ")
        assert len(words) == r.n_words
        if r.doc_id is not None and r.doc_id < 500:
            assert words == [f"w{r.doc_id}_{i}" for i in range(r.first_word, r.first_word + r.n_words)]
        taken[r.doc_id] += r.n_words
    assert {d: n for d, n in taken.items() if n} == {r.doc_id: r.n for r in report.groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0").collect()}
    slots = Counter()
    for r in got:
        slots[r.shard, r.slot] += r.n_words
    assert max(slots.values()) <= 16 and len({s for s, _ in slots}) > 3


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_report(empty).collect() == []
    assert [r.taken for r in mixing.mix_report(spark.createDataFrame([(1, None, "a"), (2, "", None)], empty.schema)).collect()] == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_permutation_is_one_to_one(spark, n):
    keys = F.transform(F.array(*(mixing.drawn("t", r) for r in range(8))), lambda v: F.struct((v % n).alias("mirror"), (v % 1000003 + 1).alias("a"), (v % 7919).alias("b")))
    out = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), keys)).collect()]
    assert sorted(out) == list(range(n)) and (n < 100 or sum(a == b for a, b in enumerate(out)) < n // 4)


def test_sums_in_order_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v")).repartition(7)
    got = {r.k: r.s for r in mixing.in_order(Scratch(spark), df, [F.col("k")], {"s": F.col("v")}).collect()}
    total, want = 0, {}
    for r in sorted(df.collect()):
        want[r.k], total = total, total + r.v
    assert got == want


# ranked search

def brute_search(docs, items, k=10):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(t))
    rows = [(d, Counter(w), len(w)) for d, t in docs if (w := terms(t))]
    documents, total = len(rows), sum(n for *_, n in rows)
    having = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c, n in rows:
            m = 10 + 90 * n * documents // total
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * having[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item_id, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


SEARCH_ODD = [(None, "the of w1"), (900, None), (901, ""), (902, "... !!"), (903, "The, THE; the-w1"), (904, "Été w1 한국 w2"), (905, "w1 " * 5000), (906, "the of w1"), (906, "the of w1")]
ITEMS = [(1, "The w1 w2 of"), (2, None), (3, ""), (4, "nowhere xyzzy"), (5, "été 한국"), (None, "w3 w4 w5"), (6, "w1"), (6, "w1"), (7, " ".join(WORDS[:40]))]


@pytest.mark.parametrize("options", [{}, {"BLOCK_DOCS": 3}, {"PASS_CHARS": 40, "BLOCK_DOCS": 7, "FIRST": 1}])
def test_ranked_search(spark, monkeypatch, options):
    for name, value in options.items():
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(5)
    copy = " ".join(rng.choices(WORDS, k=12))
    docs = [(k, " ".join(rng.choices(WORDS, k=rng.choice([3, 12, 12, 40])))) for k in range(120)] + [(k, copy) for k in range(200, 260)] + SEARCH_ODD
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"), "n", "m", "terms", "tfs", "item", "score", "rank", "item_id").repartition(4)
    items = clashing(spark.createDataFrame(ITEMS, "item_id long, text string"), "doc_id", "item", "score")
    got = sorted(map(tuple, lexical_search.ranked_search(df, items).collect()), key=str)
    assert got == brute_search(docs, ITEMS)


def test_ranked_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "the")], "doc_id long, text string")
    for a, b in ((docs, items), (some, items), (docs, some.withColumnRenamed("doc_id", "item_id"))):
        assert lexical_search.ranked_search(a, b).collect() == []


# hard negatives

def brute_negatives(rows):
    usable = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256.0 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, v in usable:
        if a % 50:
            continue
        scored = sorted((-product(v, w), i, other) for i, other, w in usable if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fits[:3], 1)]
    return sorted(out)


def vectors(n, seed=1, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dims))
    x[n // 2 :: 3] = x[0]  # a group of copies
    return [(k, x[k].tolist(), int(rng.integers(0, 10))) for k in range(n)]


VECTOR_ODD = [(50, None, 1), (100, [0.1] * 6, None), (None, [0.2] * 6, 3), (1001, [float("nan")] * 6, 2), (1002, [0.5, None, 0.1, 0.1, 0.1, 0.1], 2), (1003, [float("inf")] * 6, 2), (1004, [0.3, 0.2], 4), (1005, [], 5), (150, [0.4, -0.2, 0.1, 0.3, 0.0, 0.2], 1), (-50, [0.1, 0.9, -0.4, 0.0, 0.2, 0.3], 7)]


@pytest.mark.parametrize("options", [{}, {"LEAF": 8, "FAN": 3, "SLICE": 5}, {"LEAF": 20, "FAN": 4}])
def test_hard_negatives(spark, monkeypatch, options):
    for name, value in options.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(260) + VECTOR_ODD
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "leaf", "v", "uid", "rank", "score", "low").repartition(3)
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, sample=64).collect()))
    assert got == brute_negatives(rows) and len(got) > 20


def test_hard_negatives_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(0, [1.0, 2.0], 3)], [(0, None, 3), (50, [float("nan")], 1)], [(0, [0.0], 1), (1, [0.0], 2), (2, [0.0], 2)]):
        assert sorted(map(tuple, hard_negatives.hard_negatives(spark.createDataFrame(rows, schema)).collect())) == brute_negatives(rows)


def test_tree_reaches_every_vector_in_a_window(monkeypatch):
    monkeypatch.setattr(hard_negatives, "FAN", 4)
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(500, 5)))
    tree = hard_negatives.Tree(x[:100], float(np.square(x).sum(axis=1).max()), 3)
    tree.ranges = [(np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for p in tree.points]

    def seen(node, d, own):
        for c in np.unique(own):
            tree.ranges[node][0][:, c] = np.minimum(tree.ranges[node][0][:, c], d[own == c].min(axis=0))
            tree.ranges[node][1][:, c] = np.maximum(tree.ranges[node][1][:, c], d[own == c].max(axis=0))

    leaf = tree.walk(x, seen)
    s = x[:40] @ x.T
    low, high = np.quantile(s, 0.97, axis=1)[:, None], np.quantile(s, 0.99, axis=1)[:, None]
    reached = set(zip(*(a.tolist() for a in tree.reached(x[:40], low, high))))
    needed = {(q, int(leaf[i])) for q, i in zip(*np.nonzero((s >= low) & (s <= high)))}
    assert needed <= reached and len(reached) < 40 * tree.leaves
