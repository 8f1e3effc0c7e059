import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import cases, metrics, profiles, text
from fleetlens.sources import telemetry

PRED = "sample_id string, vehicle_id string, model_name string, task_type string, fault_type string, split string, y_true int, y_score double, threshold double, y_pred int, lead_time_sec int, end_time long"


def predictions(spark, truth, scores, leads=None):
    rows = [(f"s{k}", "v", "m", "warn", "sd", "test", t, s, 0.5, int(s >= 0.5), (leads or [None] * len(truth))[k], k) for k, (t, s) in enumerate(zip(truth, scores))]
    return spark.createDataFrame(rows, PRED)


def test_perfect_scores(spark):
    p = predictions(spark, [1, 0, 0, 1, 1], [0.77, 0.31, 0.05, 0.64, 0.58], [50, 10, None, 10, None])
    b, r, w = metrics.binary_metrics(p).first(), metrics.ranking_metrics(p).first(), metrics.warning_metrics(p).first()
    assert (b.accuracy, b.f1, b.recall, r.pr_auc, r.roc_auc, w.warning_f1, w.avg_lead_time, w.false_alarm_rate) == (1, 1, 1, 1, 1, 1, 30, 0)


def test_one_class(spark):
    one = metrics.ranking_metrics(predictions(spark, [1, 1], [0.1, 0.2])).first()
    assert one.pr_auc is None and one.roc_auc is None


def naive_best(truth, scores, default=0.5):
    pairs = [(t, s) for t, s in zip(truth, scores) if s == s and abs(s) != float("inf")]
    if not 0 < sum(t for t, _ in pairs) < len(pairs):
        return default
    found = []
    for cut in {s for _, s in pairs} | {default}:
        tp = sum(t for t, s in pairs if s >= cut)
        hits, all_pos = sum(s >= cut for _, s in pairs), sum(t for t, _ in pairs)
        found.append((-(2 * tp / (hits + all_pos)), -tp / all_pos, -(tp / hits if hits else 0), cut))
    return min(found)[-1]


def test_best_threshold_against_loops(spark):
    rng, by = np.random.default_rng(6), ("model_name",)
    cases_ = [([1, 1, 1], [0.3, 0.2, 0.7]), ([0, 1, 1, 0], [0.31, float("nan"), 0.44, float("inf")])]
    for n in (5, 40, 300):
        truth = rng.integers(0, 2, n)
        cases_.append((truth.tolist(), np.round(np.clip(truth * 0.2 + rng.random(n) * 0.8, 0, 1), 2).tolist()))
    for truth, scores in cases_:
        got = metrics.best_thresholds(predictions(spark, truth, scores), by).first().threshold
        assert got == naive_best(truth, scores)


def test_ranking_against_loops(spark):
    rng = np.random.default_rng(2)
    truth, scores = rng.integers(0, 2, 200), np.round(rng.normal(0, 1, 200), 1)
    r = metrics.ranking_metrics(predictions(spark, truth.tolist(), scores.tolist())).first()
    pos, neg = scores[truth == 1], scores[truth == 0]
    roc = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
    cuts = sorted(set(scores), reverse=True)
    recall = np.array([(pos >= c).mean() for c in cuts])
    ap = (np.diff(recall, prepend=0) * np.array([(pos >= c).sum() / (scores >= c).sum() for c in cuts])).sum()
    assert abs(r.roc_auc - roc) < 1e-12 and abs(r.pr_auc - ap) < 1e-12


def test_tree_baseline(spark):
    """Learns a threshold; a fault with one class in training gets that class as its score."""
    rng = np.random.default_rng(1)
    rows = [(f"s{k}", f"v{k % 9}", ("train", "val", "test")[k % 3], float(x := rng.random()), float(rng.random()), int(x > 0.6), 0, 1) for k in range(600)]
    df = spark.createDataFrame(rows, "sample_id string, vehicle_id string, split string, a double, b double, y_id_sd int, y_id_isc int, y_id_ins int")
    out = metrics.tree_baseline(df, ["a", "b"], ("sd", "isc", "ins"))
    test = out.where("split = 'test' and fault_type = 'sd'").collect()
    assert np.mean([(r.y_score >= 0.5) == bool(r.y_true) for r in test]) > 0.95
    assert {(r.fault_type, r.y_score) for r in out.where("fault_type <> 'sd'").select("fault_type", "y_score").distinct().collect()} == {("isc", 0.0), ("ins", 1.0)}
    assert out.count() == 1800


def test_trees_are_scored_in_one_pass(spark):
    """All faults come from one reading of the table, and nothing that training kept stays."""
    rng = np.random.default_rng(2)
    rows = [(f"s{k}", f"v{k % 9}", ("train", "val")[k % 2], float(x := rng.random()), int(x > 0.6), int(x < 0.3)) for k in range(300)]
    df = spark.createDataFrame(rows, "sample_id string, vehicle_id string, split string, a double, y_id_sd int, y_id_isc int")
    out = metrics.tree_baseline(df, ["a"], ("sd", "isc"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") == 1 and "InMemoryRelation" not in plan
    good = out.where("(y_score >= 0.5) = (y_true = 1)").groupBy("fault_type").count().collect()
    assert {r[0] for r in good} == {"sd", "isc"} and min(r[1] for r in good) > 290


def test_cases(spark):
    p = predictions(spark, [1, 1, 1, 0, 1, 1], [0.9, 0.8, 0.7, 0.1, 0.2, 0.6])
    assert cases.false_negatives(p).first().sample_id == "s4"
    tp = cases.true_positives(p)
    assert tp.first().sample_id == "s1"
    series = cases.case_context(p, tp).where("series = 'score'").orderBy("x").collect()
    assert [r.x for r in series] == [-1, 0, 1]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 2.0), (3, None, 4.0)], "i int, s string, x double")
    rows = {r.column: r for r in profiles.dataset_profile(df).collect()}
    assert rows["s"].distinct == 1 and rows["i"].median == 2 and rows["x"].mean == 3 and abs(rows["x"].missing_pct - 100 / 3) < 1e-9


def naive_chunks(t, size, overlap):
    """The rule of ``split_text`` by cutting one character at a time."""
    out, at = [], 0
    while at < len(t):
        end = min(len(t), at + size)
        if end < len(t):
            for mark in text.SEPARATORS:
                places = [k for k in range(at + overlap + 1, end) if t[k : k + len(mark)] == mark and k + len(mark) <= end]
                if places:
                    end = places[-1] + len(mark)
                    break
        if t[at:end].strip():
            out.append(t[at:end].strip())
        if end == len(t):
            return out
        at = max(end - overlap, at + 1)
    return out


def test_chunks_against_loops(spark):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:80]
    rows += [(1001, "s", "甲。" * 100 + "word " * 300 + "\n\n" + "x" * 1200), (1002, "s", ""), (1003, "s", None), (1004, "s", "short"), (1005, "s", " \n " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for size, overlap in ((500, 50), (40, 7)):
        got = sorted((r.doc_id, r.chunk_no, r.text) for r in text.chunk_documents(docs, size, overlap).collect())
        assert got == sorted((i, k, c) for i, _, t in rows for k, c in enumerate(naive_chunks(t or "", size, overlap)))


def test_top_k_against_matrix(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, e array<double>").select("vec_id", text.normalised(F.col("e")).alias("v")).repartition(5)
    v = v.unionByName(v.where("vec_id < 40").withColumn("vec_id", F.col("vec_id") + 100))  # ties go by id
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"))
    got = {(r.query_id, r["rank"]): r.id for r in text.top_k(v, q, 3, block=4).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = [*range(60), *range(100, 140)]
    for j in (i for i in ids if i % 10 == 0):
        score = {i: float(np.round(n[i % 100] @ n[j % 100], 12)) for i in ids}
        want = sorted(ids, key=lambda i: (-score[i], i))[:3]
        assert [score[got[j, k]] for k in (1, 2, 3)] == [score[i] for i in want] and got[j, 1] == want[0]


def test_file_rules(spark):
    df = spark.createDataFrame([("see 'C:\\logs\\run 1' or /srv/data/run.2.parquet。 now",), ("D:\\fleet\\may.XLSX! and /tmp/a.csv",), ("http://h/p.json?x=1",), ("文件里第 7 个文件",), ("第十文件",), ("第二 个 文件, 第九文件",), ("nothing.csv here",), (None,)], "t string")
    got = [tuple(r) for r in df.select(text.file_path(F.col("t")), text.file_ordinal(F.col("t"))).collect()]
    assert got == [("/srv/data/run.2.parquet", None), ("D:\\fleet\\may.XLSX", None), ("//h/p.json", None), (None, 7), (None, 10), (None, 9), (None, None), (None, None)]


def test_sources(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "car1.csv").write_text("﻿TIME,CHARGE_STATUS,SPEED,U_10,U_2,T_1\n1,3,x,4.1,3.9,20\n11,3,5,4.0,,21\n", encoding="utf-8")
    got = telemetry.read_structured(spark, f"file://{tmp_path}/s").orderBy("frame_index").collect()
    assert got[0].vehicle_id == "car1" and got[0].voltages == [3.9, 4.1] and got[0].speed == 0.0 and got[1].voltages == [0.0, 4.0]
    raw = tmp_path / "raw"
    (raw / "vin1").mkdir(parents=True)
    (raw / "vin1" / "b.csv").write_text("terminaltime,chargestatus,batteryvoltage,probetemperatures\n1,3,3.7~3.8,30~31\n")
    (raw / "vin1" / "a.csv").write_text("terminaltime,chargestatus,batteryvoltage,probetemperatures\n1,3,3.7~3.8,30~31\n")
    (raw / "flat.csv").write_text("terminaltime\n1\n")
    (raw / "vin2.rar").write_text("x")
    rows = {(r.vehicle_id, r.entry_kind, r.is_extracted) for r in telemetry.scan_files(spark, f"file://{tmp_path}/s", f"file://{raw}").collect()}
    assert rows == {("car1", "csv", True), ("vin1", "directory", True), ("flat", "csv", True), ("vin2", "archive", False)}
    r = telemetry.read_raw(spark, f"file://{raw}/vin1/a.csv").first()
    assert r.voltages == [3.7, 3.8] and r.insulation_resistance == 0.0
    with pytest.raises(ValueError, match="batteryvoltage"):
        telemetry.read_raw(spark, f"file://{raw}/flat.csv")
    for ending, body in (("tsv", "a\tb\n1\tx\n"), ("csv", "a,b\n1,x\n"), ("json", '{"a": 1, "b": "x"}\n')):
        (tmp_path / f"t.{ending}").write_text(body)
        assert tuple(telemetry.read_dataset(spark, f"file://{tmp_path}/t.{ending}").select("a", "b").first()) == (1, "x")
    for ending in ("csv", "tsv", "json"):
        (tmp_path / f"g.{ending}").write_bytes({"csv": "名,数\n电池,4\n", "tsv": "名\t数\n电池\t4\n", "json": '{"名": "电池", "数": 4}\n'}[ending].encode("gbk"))
        assert tuple(telemetry.read_dataset(spark, f"file://{tmp_path}/g.{ending}").select("名", "数").first()) == ("电池", 4)
    with pytest.raises(ValueError):
        telemetry.read_dataset(spark, "x.xls")


def test_rows_of_a_split_file_keep_their_order(spark, tmp_path):
    (tmp_path / "long.csv").write_text("TIME,CHARGE_STATUS,U_1\n" + "".join(f"{k},3,{k % 7}\n" for k in range(4000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = telemetry.read_structured(spark, f"file://{tmp_path}/long.csv").select("frame_index", "time").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(rows) == 4000 and all(r.frame_index == int(r.time) for r in rows)


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(1.5, True, [1], None, bytearray(b"x")), (None, False, None, None, bytearray(b"y"))], "x double, b boolean, a array<int>, n int, y binary")
    for exact in (True, False):
        rows = {r.column: r for r in profiles.dataset_profile(df, exact).collect()}
        assert rows["x"].median == 1.5 and rows["a"].distinct is None and rows["n"].distinct == 0 and rows["n"].median is None and rows["y"].distinct == 2 and rows["b"].q1 is None


def test_history_skips_blank(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, "b"), (1, 2, "bot", "c"), (1, 3, "user", "d")], "conv_id int, turn int, role string, text string")
    assert [r.history for r in text.recent_history(df).orderBy("turn").collect()] == ["", "user: a", "user: a", "user: a\nbot: c"]
