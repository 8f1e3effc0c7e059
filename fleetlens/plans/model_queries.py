"""Queries of thresholds, metrics, comparison tables and cases, over predictions derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sensors import FAULTS
from ..operators import cases, features, metrics
from ..operators.splits import with_splits
from ..sources.shared import Scratch
from . import fixtures as X
from . import fleet_queries as fleet
from . import oracle as O
from .registry import Query

CORE, RARE = ("sd", "samp", "ins"), ("isc", "conn")
ORDER = ["threshold_trend", "lightgbm", "lstm"]
_G = "model_name, task_type, fault_type, split"
_GC = "model_name:s task_type:s fault_type:s split:s"
_P = O.PREDICTIONS


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _counts(source: str, by: str, pred: str = "y_pred = 1", extra: str = "") -> str:
    return f"SELECT {by}, count(*) FILTER (y_true = 1 AND {pred}) AS tp, count(*) FILTER (y_true <> 1 AND {pred}) AS fp, count(*) FILTER (y_true = 1 AND NOT {pred}) AS fn, count(*) FILTER (y_true <> 1 AND NOT {pred}) AS tn{extra} FROM {source} GROUP BY {by}"


_F1 = _ratio("2.0 * tp", "2 * tp + fp + fn")
_BIN = f"bin AS (SELECT {_G}, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy, {_F1} AS f1, {_ratio('tp', 'tp + fn')} AS recall, {_ratio('tp', 'tp + fp')} AS precision FROM ({_counts('pred', _G)}))"
_WARN = f"""wrn AS (SELECT {_G}, {_F1} AS warning_f1, {_ratio('tp', 'tp + fn')} AS warning_recall,
 CAST(fp AS DOUBLE) / greatest(fp + tn, 1) AS false_alarm_rate, avg_lead_time FROM ({_counts('pred', _G, extra=', avg(CASE WHEN y_pred = 1 AND y_true = 1 THEN lead_time_sec END) AS avg_lead_time')}))"""
_RANK = f"""rk0 AS (SELECT {_G}, y_score, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true <> 1) AS neg FROM pred GROUP BY {_G}, y_score),
 rk1 AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER p AS ap, sum(neg) OVER p AS an FROM rk0 WINDOW d AS (PARTITION BY {_G} ORDER BY y_score DESC),
 p AS (PARTITION BY {_G})),
rnk AS (SELECT {_G}, CASE WHEN min(least(ap, an)) > 0 THEN sum(CAST(pos AS DOUBLE) / ap * tp / (tp + fp)) END AS pr_auc,
 CASE WHEN min(least(ap, an)) > 0 THEN sum(CAST(neg AS DOUBLE) / an * (tp - pos / CAST(2 AS DOUBLE)) / ap) END AS roc_auc FROM rk1 GROUP BY {_G})"""
_T = "model_name, task_type, fault_type"


def _best(source: str, by: str, name: str = "thr") -> str:
    return f"""{name}0 AS (SELECT {by}, y_score, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM (SELECT {by}, y_score, y_true
 FROM {source} UNION ALL SELECT DISTINCT {by}, CAST(0.5 AS DOUBLE), NULL FROM {source}) GROUP BY ALL),
{name}1 AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER p AS ap, sum(neg) OVER p AS an FROM {name}0 WINDOW d AS (PARTITION BY {by} ORDER BY y_score DESC),
 p AS (PARTITION BY {by})), {name}2 AS (SELECT *, ap - tp AS fn FROM {name}1),
{name} AS (SELECT {by}, CASE WHEN ap > 0 AND an > 0 THEN y_score ELSE 0.5 END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {_F1} DESC, {_ratio('tp', 'ap')} DESC, {_ratio('tp', 'tp + fp')} DESC, y_score) AS rn FROM {name}2) WHERE rn = 1)"""


_CMP = f"""cmp AS (SELECT model_name AS model_key, count(DISTINCT fault_type) AS fault_count, avg(f1) AS f1, avg(recall) AS recall FROM bin
 WHERE split = 'test' AND fault_type IN ('sd', 'samp', 'ins') GROUP BY 1)"""
_RULES = {"sd": [("sd_cell_dev_min", "low"), ("sd_rest_drop_rate", "low"), ("shared_v_range", "high")], "ins": [("ins_rins_min", "low"), ("ins_threshold_margin", "low"), ("ins_rins_slope", "low")], "samp": [("samp_sensor_jump_count", "high"), ("samp_pack_sum_residual", "high"), ("samp_abnormal_count_ratio", "high")]}
_CASEW = "PARTITION BY fault_type, vehicle_id ORDER BY end_time, sample_id"
_CASES = f"""{_P}, {{extra}}cp0 AS (SELECT *, y_score - threshold AS margin, row_number() OVER ({_CASEW}) AS place, y_true = 1 AND y_pred = 1 AS hit FROM {{source}} WHERE end_time IS NOT NULL),
cp1 AS (SELECT *, CASE WHEN hit THEN place - row_number() OVER (PARTITION BY fault_type, vehicle_id, hit ORDER BY end_time, sample_id) END AS run FROM cp0),
 cp AS (SELECT *, CASE WHEN hit THEN count(*) OVER r END AS run_length, CASE WHEN hit THEN min(place) OVER r END AS run_start,
 CASE WHEN hit THEN max(place) OVER r END AS run_end FROM cp1 WINDOW r AS (PARTITION BY fault_type, vehicle_id, run)),
fnc AS (SELECT 'false_negative' AS case_type, * FROM (SELECT *, row_number() OVER (PARTITION BY fault_type
 ORDER BY margin, y_score DESC, vehicle_id, end_time, sample_id) AS rn FROM cp WHERE y_true = 1 AND y_pred = 0) WHERE rn = 1),
tpc AS (SELECT 'true_positive' AS case_type, * FROM (SELECT *, row_number() OVER (PARTITION BY fault_type
 ORDER BY run_length DESC, abs(place - (run_start + run_end) / CAST(2 AS DOUBLE)), margin DESC, y_score DESC, vehicle_id, end_time, sample_id) AS rn FROM cp
 WHERE hit) WHERE rn = 1)"""
_CASES = _CASES.format(extra="", source="pred")
_CASE = "case_type:s fault_type:s vehicle_id:s sample_id:s y_score:d margin:d place:i"


def _thresholds(s: SparkSession, d: str) -> DataFrame:
    return metrics.best_thresholds(X.predictions(s, d).where("split = 'val'"), extra=(0.25, 0.75))


def _compared(s: SparkSession, d: str, faults=CORE) -> DataFrame:
    return metrics.compare_models(metrics.binary_metrics(X.predictions(s, d)), ["f1", "recall"], faults, ORDER)


def _model_table(s: SparkSession, d: str, columns=None) -> DataFrame:
    """Samples with split and features (or those of ``columns``), these rounded to four digits; written once by columns, as several passes read a few of them."""
    x = with_splits(X.samples(s, d), X.split_map(s, d))
    f = features.window_features(X.frames(s, d), X.samples(s, d), X.WINDOW, False)
    f = f.select("sample_id", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in f.columns if c != "sample_id" and (columns is None or c in columns)))
    return Scratch(s).keep(x.join(f, "sample_id"), "model")


_RULE_ROWS = " UNION ALL ".join(
    f"SELECT sample_id, vehicle_id, split, lead_time_sec, '{f}' AS fault_type, {k} AS rule, '{c}' AS rule_feature, {int(way == 'high')} AS up, round(CAST({c} AS DOUBLE), 4) AS x, y_warn_{f} AS y_true FROM ss JOIN feat USING (sample_id)"
    for f, rules in _RULES.items() for k, (c, way) in enumerate(rules)
)
_BASELINE = f"""{fleet.FEATURES}, {O.SPLIT_MAP}, ss AS (SELECT samples.*, coalesce(split, 'external_test') AS split FROM samples LEFT
 JOIN split_map USING (vehicle_id)), rr AS ({_RULE_ROWS}),
rg AS (SELECT fault_type, rule, min(x) AS lo, max(x) AS hi FROM rr WHERE split = 'train' GROUP BY 1, 2), rs0 AS (SELECT rr.*,
 CASE WHEN hi > lo THEN least(1, greatest(0, (x - lo) / (hi - lo))) ELSE 0 END AS z FROM rr JOIN rg USING (fault_type, rule)),
rs AS (SELECT *, CASE WHEN up = 1 THEN z ELSE 1 - z END AS y_score FROM rs0), vl AS (SELECT * FROM rs WHERE split = 'val'), {_best('vl', 'fault_type, rule')},
vm AS (SELECT vl.*, threshold FROM vl JOIN thr USING (fault_type, rule)), vq AS ({_counts('vm', 'fault_type, rule, threshold', 'y_score >= threshold')}),
bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fault_type ORDER BY {_F1} DESC, {_ratio('tp', 'tp + fn')} DESC,
 CAST(fp AS DOUBLE) / greatest(fp + tn, 1), rule) AS rn FROM vq) WHERE rn = 1)"""


def _rule_baseline(s: SparkSession, d: str) -> DataFrame:
    return metrics.rule_baseline(_model_table(s, d, {c for rules in _RULES.values() for c, _ in rules}), _RULES)


def _tree_baseline(s: SparkSession, d: str) -> DataFrame:
    t = _model_table(s, d)
    names = [c for c in t.columns if c.split("_")[0] in features.GROUPS]
    return metrics.tree_baseline(t, names, FAULTS).groupBy("fault_type", "split").agg(F.count("*").alias("rows"), F.avg("y_score").alias("score"))


def _all_cases(s: SparkSession, d: str) -> DataFrame:
    p = X.predictions(s, d)
    return cases.false_negatives(p).unionByName(cases.true_positives(p))


def _summary(s: SparkSession, d: str) -> DataFrame:
    p = X.predictions(s, d)
    return metrics.summary("run", metrics.binary_metrics(p), metrics.warning_metrics(p))


QUERIES = [
    Query(
        "met1_binary",
        lambda s, d: metrics.binary_metrics(X.predictions(s, d)),
        f"{_GC} accuracy:d f1:d recall:d precision:d",
        f"{_P}, {_BIN}|||SELECT * FROM bin",
    ),
    Query("met2_ranking", lambda s, d: metrics.ranking_metrics(X.predictions(s, d)), f"{_GC} pr_auc:d roc_auc:d", f"{_P}, {_RANK}|||SELECT * FROM rnk"),
    Query(
        "met3_warning",
        lambda s, d: metrics.warning_metrics(X.predictions(s, d)),
        f"{_GC} warning_f1:d warning_recall:d false_alarm_rate:d avg_lead_time:d",
        f"{_P}, {_WARN}|||SELECT * FROM wrn",
    ),
    Query(
        "met4_multilabel",
        lambda s, d: metrics.multilabel_metrics(X.predictions(s, d), CORE),
        "model_name:s task_type:s fault_scope:s macro_f1:d micro_f1:d sample_count:i fault_count:i",
        f"""{_P}, sp AS (SELECT *, 'all_faults' AS fault_scope FROM pred UNION ALL SELECT *, 'core_faults' FROM pred
 WHERE fault_type IN ('sd', 'samp', 'ins')), mc AS ({_counts('sp', 'model_name, task_type, fault_scope, fault_type')}),
mm AS (SELECT model_name, task_type, fault_scope, avg({_F1}) AS macro_f1, {_ratio('2.0 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')} AS micro_f1,
 count(*) AS fault_count FROM mc GROUP BY 1, 2, 3)|||SELECT mm.*, sample_count FROM mm JOIN (SELECT model_name, task_type, fault_scope,
 count(DISTINCT sample_id) AS sample_count FROM sp GROUP BY 1, 2, 3) USING (model_name, task_type, fault_scope)""",
    ),
    Query(
        "met5_best_threshold",
        _thresholds,
        "model_name:s task_type:s fault_type:s threshold:d",
        f"""{_P}, vp AS (SELECT * FROM pred WHERE split = 'val'), vx AS (SELECT {_T}, y_score, y_true FROM vp UNION ALL SELECT DISTINCT {_T}, unnest([CAST(0.25 AS DOUBLE), 0.75]), NULL
 FROM vp), {_best('vx', _T)}|||SELECT * FROM thr""",
    ),
    Query(
        "met6_apply_threshold",
        lambda s, d: metrics.apply_thresholds(X.predictions(s, d).drop("threshold", "y_pred").where("split = 'test'"), _thresholds(s, d)).groupBy("model_name", "task_type", "fault_type").agg(F.count("*").alias("rows"), F.sum("y_pred").alias("positives")),
        "model_name:s task_type:s fault_type:s rows:i positives:i",
        f"""{_P}, vp AS (SELECT * FROM pred WHERE split = 'val'), vx AS (SELECT {_T}, y_score, y_true FROM vp UNION ALL SELECT DISTINCT {_T}, unnest([CAST(0.25 AS DOUBLE), 0.75]), NULL
 FROM vp), {_best('vx', _T)}|||SELECT {_T}, count(*) AS rows, count(*) FILTER (y_score >= thr.threshold) AS positives FROM pred
 JOIN thr USING ({_T}) WHERE split = 'test' GROUP BY ALL""",
    ),
    Query(
        "met6b_wide_to_long",
        lambda s, d: metrics.wide_to_long(X.raw_labels(s, d).select("vehicle_id", "frame_index", *(F.col(f"label_raw_{f}").alias(f"score_{f}") for f in FAULTS)), ["vehicle_id", "frame_index"], FAULTS),
        "vehicle_id:s frame_index:i fault_type:s y_score:d",
        f"{O.RAW_LABELS}|||" + " UNION ALL ".join(f"SELECT vehicle_id, frame_index, '{f}' AS fault_type, label_raw_{f} AS y_score FROM raw" for f in FAULTS),
    ),
    Query("met7_rule_baseline", _rule_baseline, "sample_id:s fault_type:s y_true:i y_pred:i y_score:d threshold:d rule_feature:s", f"""{_BASELINE}
|||SELECT sample_id, fault_type, y_true, CAST(y_score >= threshold AS INT) AS y_pred, y_score, threshold, rule_feature FROM rs JOIN bst USING (fault_type, rule) WHERE split = 'test'"""),
    Query("met8_tree_baseline", _tree_baseline, "fault_type:s split:s rows:i score:d"),
    Query(
        "met9_summary",
        _summary,
        f"experiment_name:s {_GC} accuracy:d f1:d warning_f1:d avg_lead_time:d macro_f1:d",
        f"""{_P}, {_BIN}, {_WARN}|||SELECT 'run' AS experiment_name, {_G}, accuracy, f1, NULL AS warning_f1, NULL AS avg_lead_time, NULL AS macro_f1 FROM bin
 UNION ALL SELECT 'run', {_G}, NULL, NULL, warning_f1, avg_lead_time, NULL FROM wrn""",
    ),
    Query(
        "met9b_rare",
        lambda s, d: metrics.only_faults(_summary(s, d), RARE),
        f"{_GC} f1:d warning_f1:d",
        f"""{_P}, {_BIN}, {_WARN}|||SELECT * FROM (SELECT {_G}, f1, NULL AS warning_f1 FROM bin UNION ALL SELECT {_G}, NULL, warning_f1 FROM wrn)
 WHERE fault_type IN ('isc', 'conn')""",
    ),
    Query(
        "met9c_acceptance",
        lambda s, d: metrics.acceptance(_summary(s, d), metrics.only_faults(_summary(s, d), CORE), metrics.only_faults(_summary(s, d), RARE)),
        "core_passed:b",
        f"""{_P}|||SELECT count(*) > 0 AND count(*) FILTER (fault_type IN ('sd', 'samp', 'ins')) > 0 AND count(*) FILTER (fault_type IN ('isc', 'conn')) > 0 AS core_passed
 FROM pred""",
    ),
    Query(
        "met10_compare",
        _compared,
        "model_key:s model_name:s fault_count:i f1:d recall:d place:i",
        f"""{_P}, {_BIN}, {_CMP}|||SELECT *, CASE model_key WHEN 'lightgbm' THEN 'LightGBM' WHEN 'lstm' THEN 'LSTM' ELSE 'Threshold Trend' END AS model_name,
 CASE model_key WHEN 'threshold_trend' THEN 1 WHEN 'lightgbm' THEN 2 ELSE 3 END AS place FROM cmp""",
    ),
    Query(
        "met11_bars",
        lambda s, d: metrics.metric_bars(_compared(s, d), "model_name", ["f1", "recall"]),
        "plot_type:s series:s category:s value:d",
        f"""{_P}, {_BIN}, {_CMP}, nm AS (SELECT *, CASE model_key WHEN 'lightgbm' THEN 'LightGBM' WHEN 'lstm' THEN 'LSTM' ELSE 'Threshold Trend' END AS n
 FROM cmp)|||SELECT 'bar_metric' AS plot_type, 'f1' AS series, n AS category, f1 AS value FROM nm UNION ALL SELECT 'bar_metric', 'recall', n, recall FROM nm""",
    ),
    Query(
        "met12_best_model",
        lambda s, d: metrics.best_by_metric(_compared(s, d), ["f1", "recall"]),
        "metric:s model_key:s value:d",
        f"""{_P}, {_BIN}, {_CMP}|||SELECT 'f1' AS metric, * FROM (SELECT model_key, f1 AS value FROM cmp ORDER BY f1 DESC, model_key LIMIT 1)
 UNION ALL SELECT 'recall', * FROM (SELECT model_key, recall FROM cmp ORDER BY recall DESC, model_key LIMIT 1)""",
    ),
    Query(
        "met13_rates",
        lambda s, d: metrics.confusion_rates(metrics.binary_metrics(p := X.predictions(s, d)), metrics.warning_metrics(p)),
        f"{_GC} rate:s value:d",
        f"""{_P}, {_BIN}, {_WARN}, bw AS (SELECT {_G}, recall, false_alarm_rate FROM bin JOIN wrn USING ({_G}))|||SELECT {_G}, 'TPR' AS rate, recall AS value
 FROM bw UNION ALL SELECT {_G}, 'FNR', 1 - recall FROM bw UNION ALL SELECT {_G}, 'FPR', false_alarm_rate FROM bw UNION ALL SELECT {_G}, 'TNR', 1 - false_alarm_rate
 FROM bw""",
    ),
    Query(
        "met14_ablation",
        lambda s, d: metrics.ablation(_compared(s, d), "lightgbm", ["f1", "recall"]),
        "model_key:s f1:d recall:d delta_f1:d delta_recall:d",
        f"""{_P}, {_BIN}, {_CMP}, b1 AS (SELECT f1 AS bf, recall AS br FROM cmp
 WHERE model_key = 'lightgbm')|||SELECT model_key, f1, recall, bf - f1 AS delta_f1, br - recall AS delta_recall FROM cmp, b1""",
    ),
    Query(
        "met15_lead_times",
        lambda s, d: metrics.lead_times(X.predictions(s, d)),
        "fault_type:s n:i mean:d q1:d median:d q3:d",
        f"""{_P}|||SELECT fault_type, count(*) AS n,
 avg(lead_time_sec) AS mean, quantile_cont(lead_time_sec, 0.25) AS q1, quantile_cont(lead_time_sec, 0.5) AS median, quantile_cont(lead_time_sec, 0.75) AS q3
 FROM pred WHERE y_true = 1 AND y_pred = 1 AND lead_time_sec IS NOT NULL GROUP BY 1""",
    ),
    Query(
        "jn4_prediction_samples",
        lambda s, d: cases.joined_predictions(X.predictions(s, d).drop("end_time"), X.predictions(s, d).where("event_id % 3 <> 0").select("sample_id", "vehicle_id", F.col("end_time").alias("start_time"), "end_time").distinct()),
        "sample_id:s fault_type:s end_time:i",
        f"{_P}|||SELECT sample_id, fault_type, CASE WHEN event_id % 3 <> 0 THEN end_time END AS end_time FROM pred",
    ),
    Query(
        "jn7_model_deltas",
        lambda s, d: metrics.model_deltas(_compared(s, d), _compared(s, d, RARE).where("model_key <> 'lstm'"), ["f1"]),
        "model_key:s f1:d delta_f1:d",
        f"""{_P}, {_BIN}, {_CMP}, rar AS (SELECT model_name AS model_key, avg(f1) AS rf FROM bin
 WHERE split = 'test' AND fault_type IN ('isc', 'conn') AND model_name <> 'lstm' GROUP BY 1)|||SELECT model_key, f1, f1 - rf AS delta_f1 FROM cmp LEFT
 JOIN rar USING (model_key)""",
    ),
    Query("cas1_false_negative", lambda s, d: cases.false_negatives(X.predictions(s, d)), _CASE, f"{_CASES}|||SELECT * FROM fnc"),
    Query("cas2_true_positive", lambda s, d: cases.true_positives(X.predictions(s, d)), f"{_CASE} run_start:i run_end:i", f"{_CASES}|||SELECT * FROM tpc"),
    Query(
        "cas3_context",
        lambda s, d: cases.case_context(X.predictions(s, d), _all_cases(s, d)),
        "case_type:s fault_type:s series:s x:i x_abs:i y:d",
        f"""{_CASES}, cb AS (SELECT case_type, fault_type, vehicle_id, place AS pl,
 CASE WHEN case_type = 'true_positive' THEN run_start - 3 ELSE place - 15 END AS lo,
 CASE WHEN case_type = 'true_positive' THEN run_end ELSE place + 15 END AS hi FROM (SELECT * FROM fnc UNION ALL SELECT * FROM tpc)),
cr AS (SELECT case_type, cp.fault_type, place - pl AS x, end_time AS x_abs, y_score, threshold, y_true FROM cp
 JOIN cb ON cp.fault_type = cb.fault_type AND cp.vehicle_id = cb.vehicle_id AND place BETWEEN lo AND hi)|||SELECT case_type, fault_type, 'score' AS series, x, x_abs, y_score AS y
 FROM cr UNION ALL SELECT case_type, fault_type, 'threshold', x, x_abs, threshold FROM cr UNION ALL SELECT case_type, fault_type, 'y_true', x, x_abs, y_true
 FROM cr UNION ALL SELECT case_type, fault_type, 'selected_window', x, x_abs, 0 FROM cr WHERE x = 0""",
    ),
    Query(
        "cas4_first_cases",
        lambda s, d: cases.first_cases(_all_cases(s, d), {"true_positive": ["none", "isc", "sd"], "false_negative": ["samp", "ins"]}),
        _CASE,
        f"{_CASES}|||SELECT * FROM fnc WHERE fault_type = 'samp' UNION ALL SELECT * FROM tpc WHERE fault_type = 'isc'",
    ),
]
