"""Profiles merged from parts, and vector search with runs left out, held against whole passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import profiles, text


def near(a, b):
    return (a is None and b is None) or abs(a - b) <= 1e-9 * max(1, abs(b))


def test_merged_parts_equal_one_pass(spark):
    rows = spark.range(6000).select(F.col("id"), (F.col("id") * 7919 % 1009).alias("x"), F.when(F.col("id") % 5 > 0, F.sqrt("id")).alias("y"), F.concat(F.lit("k"), F.col("id") % 40).alias("name"), F.array("id").alias("list"))
    parts = profiles.profile_parts(rows, F.floor(F.col("id") / 1700))
    assert parts.count() == 4 * 5
    exact = {r.column: r for r in profiles.dataset_profile(rows).collect()}
    merged = {r.column: r for r in profiles.merge_parts(parts).collect()}
    assert merged.keys() == exact.keys()
    for c, want in exact.items():
        got = merged[c]
        assert got.dtype == want.dtype and all(near(got[k], want[k]) for k in ("missing_pct", "mean", "std", "min", "max"))
        assert (got.distinct is None) == (want.distinct is None) and (want.distinct is None or abs(got.distinct - want.distinct) <= 0.07 * want.distinct)
    for c in ("id", "x", "y"):
        values = np.array([r[0] for r in rows.select(c).where(F.col(c).isNotNull()).collect()], dtype=float)
        for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert (values < merged[c][q]).mean() - 0.02 <= p <= (values <= merged[c][q]).mean() + 0.02
    some = profiles.merge_parts(parts.where("part in ('0', '2')")).where("column = 'id'").first()
    assert (some.min, some.max) == (0.0, 5099.0) and abs(some.mean - np.r_[0:1700, 3400:5100].mean()) < 1e-9


def test_parts_of_nulls_and_of_nothing(spark):
    none = spark.createDataFrame([(None, None), (None, None)], "a double, b string")
    got = {r.column: r for r in profiles.merge_parts(profiles.profile_parts(none)).collect()}
    assert (got["a"].missing_pct, got["a"].distinct, got["a"].mean, got["a"].median) == (100.0, 0, None, None) and got["b"].distinct == 0
    assert profiles.merge_parts(profiles.profile_parts(none.where("false"))).count() == 0


def brute(rows, asked, k):
    out = set()
    for name, q in asked:
        score = sorted((-round(float(np.dot(v, q)), 12), i) for i, v in rows)[:k]
        out |= {(name, i, n) for n, (_, i) in enumerate(score, 1)}
    return out


@pytest.mark.parametrize("kind", ["clusters", "one cluster", "noise"])
def test_pruned_hits_equal_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    centres = {"clusters": rng.integers(-8, 9, (12, 16)), "one cluster": rng.integers(-8, 9, (1, 16)), "noise": np.zeros((1, 16))}[kind]
    spread = 8 if kind == "noise" else 1
    vectors = (centres[rng.integers(0, len(centres), 3000)] + rng.integers(-spread, spread + 1, (3000, 16))).astype(float)
    vectors[2500:] = vectors[:500]  # equal scores: the lower id comes first
    rows = list(enumerate(vectors.tolist()))
    df = spark.createDataFrame([*rows, (9000, None)], "vec_id long, v array<double>").repartition(4)
    asked = rows[::50]
    queries = spark.createDataFrame(asked, "query_id long, query array<double>")
    pivots, sample = text.pivots_of(df, 400, 16)
    made = spark.sparkContext.accumulator(0)
    index = text.index_vectors(df, pivots, 6)
    assert index.count() == 3000
    hits = text.top_k_pruned(index, pivots, sample, queries, 4, block=25, run=64, counter=made).collect()
    assert {(h.query_id, h.id, h["rank"]) for h in hits} == brute(rows, asked, 4) and len(hits) == 4 * len(asked)
    assert made.value <= len(asked) * 3000
    if kind == "clusters":
        assert made.value < 0.4 * len(asked) * 3000


def test_pruned_hits_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, v array<double>")
    asked = spark.createDataFrame([(5, [1.0, 1.0]), (6, [0.0, 0.0])], "query_id long, query array<double>")
    pivots, sample = text.pivots_of(df)
    hits = text.top_k_pruned(text.index_vectors(df, pivots), pivots, sample, asked, 3).collect()
    assert sorted((h.query_id, h.id, h["rank"]) for h in hits) == [(5, 1, 1), (5, 2, 2), (6, 1, 1), (6, 2, 2)]
    assert text.top_k_pruned(text.index_vectors(df, pivots), pivots, sample, asked.where("false"), 3).count() == 0
    nothing = df.where("false")
    pivots, sample = text.pivots_of(nothing)
    assert text.top_k_pruned(text.index_vectors(nothing, pivots), pivots, sample, asked, 3).count() == 0
