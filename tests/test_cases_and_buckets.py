"""Cases against a loop over the rows, and what a task holds."""

import random

import pytest

from fleetlens.operators import cases
from fleetlens.sources import telemetry


def table(spark, seed):
    rng = random.Random(seed)
    data = []
    for v in "abc":
        for f in ("sd", "ins"):
            for i in range(40):
                data.append((v, f, f"{v}{i:03d}", rng.choice([i // 2, i // 2, None]), rng.randrange(2), rng.randrange(2), rng.choice([0.25, 0.5, 0.75, 1.0]), 0.5))
    return data, spark.createDataFrame(data, "vehicle_id string, fault_type string, sample_id string, end_time long, y_true int, y_pred int, y_score double, threshold double").repartition(4)


def placed(data, f):
    out = []
    for v in "abc":
        rows = sorted((r for r in data if r[0] == v and r[1] == f and r[3] is not None), key=lambda r: (r[3], r[2]))
        hit = [r[4] == 1 and r[5] == 1 for r in rows]
        for i, r in enumerate(rows):
            a = b = i
            while hit[i] and a and hit[a - 1]:
                a -= 1
            while hit[i] and b + 1 < len(rows) and hit[b + 1]:
                b += 1
            out.append((r, i + 1, hit[i], a + 1, b + 1))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cases_equal_a_loop(spark, seed):
    data, df = table(spark, seed)
    fn = {r.fault_type: r for r in cases.false_negatives(df).collect()}
    tp = {r.fault_type: r for r in cases.true_positives(df).collect()}
    context = cases.case_context(df, cases.false_negatives(df).unionByName(cases.true_positives(df))).where("series = 'score'").collect()
    for f in ("sd", "ins"):
        rows = placed(data, f)
        r, place, *_ = min((x for x in rows if x[0][4] == 1 and x[0][5] == 0), key=lambda x: (x[0][6] - x[0][7], -x[0][6], x[0][0], x[0][3], x[0][2]))
        assert (fn[f].vehicle_id, fn[f].sample_id, fn[f].place, fn[f].run_start) == (r[0], r[2], place, None)
        near = sorted((x[1] - place, x[0][3], x[0][6]) for x in rows if x[0][0] == r[0] and abs(x[1] - place) <= 15)
        assert sorted((c.x, c.x_abs, c.y) for c in context if c.case_type == "false_negative" and c.fault_type == f) == near
        r, place, _, a, b = min((x for x in rows if x[2]), key=lambda x: (x[3] - x[4], abs(x[1] - (x[3] + x[4]) / 2), x[0][7] - x[0][6], -x[0][6], x[0][0], x[0][3], x[0][2]))
        assert (tp[f].vehicle_id, tp[f].sample_id, tp[f].place, tp[f].run_start, tp[f].run_end) == (r[0], r[2], place, a, b)
        near = sorted((x[1] - place, x[0][3], x[0][6]) for x in rows if x[0][0] == r[0] and a - 3 <= x[1] <= b)
        assert sorted((c.x, c.x_abs, c.y) for c in context if c.case_type == "true_positive" and c.fault_type == f) == near


def test_cases_sort_all_rows_once(spark):
    _, df = table(spark, 0)
    physical = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert physical(cases.true_positives(df)).count("Sort [") == 3  # all rows by place, the true positives by run, and what each task found by fault
    assert "BroadcastHashJoin" in physical(cases.false_negatives(df)) and physical(cases.false_negatives(df)).count("row_number()") <= 6


def test_tasks_follow_the_rows(spark, monkeypatch):
    """What a task sorts does not grow with the table: as many tasks as keep ROWS rows in one, and the same cases."""
    _, df = table(spark, 0)
    df = df.where("end_time is not null")
    want = sorted(map(str, cases.true_positives(df).collect()))
    monkeypatch.setattr(cases, "ROWS", 10)
    few = cases.true_positives(df)
    assert f", {-(-df.count() // 10)}), REPARTITION_BY_NUM" in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, few.collect())) == want


def test_buckets_follow_the_rows():
    assert [telemetry.bucket_count(n) for n in (0, 100_000, 1_000_000, 1_000_001, 36_000_000)] == [8, 8, 8, 16, 512]
    assert all(n / telemetry.bucket_count(n) <= 125_000 for n in range(1, 10**8, 7_654_321))
