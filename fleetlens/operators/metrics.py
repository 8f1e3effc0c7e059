"""Scores to thresholds, metrics and comparison tables.

Rank metrics first add up rows by distinct score, and sum these up by ranges of score, so one long group spreads over many tasks.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import value_range

GROUP = ("model_name", "task_type", "fault_type", "split")
SUMMARY = ("experiment_name", "model_name", "task_type", "fault_type", "split", "accuracy", "f1", "recall", "precision", "pr_auc", "roc_auc", "warning_f1", "warning_recall", "false_alarm_rate", "avg_lead_time", "macro_f1", "micro_f1")
#: Names that reports show for model keys.
DISPLAY = {
    "lightgbm": "LightGBM", "lstm": "LSTM", "transformer": "Vanilla Transformer", "threshold_trend": "Threshold Trend", "shared_encoder_expert_heads": "Proposed Method",
    "shared_encoder_no_fault_specific_features": "No Fault-Specific Features", "shared_encoder_no_expert_heads": "No Expert Heads",
    "shared_encoder_no_warning_task": "No Warning Task", "shared_encoder_no_label_quality_control": "No Label Quality Control",
}


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _confusion(pred: Column) -> dict[str, Column]:
    true = F.col("y_true") == 1
    return {"tp": count_if(true & pred), "fp": count_if(~true & pred), "fn": count_if(true & ~pred), "tn": count_if(~true & ~pred)}


def _f1(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> Column:
    return ratio(2.0 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn))


def binary_metrics(predictions: DataFrame, by=GROUP) -> DataFrame:
    """By group: accuracy, f1, recall, precision at y_score >= threshold."""
    c = predictions.groupBy(*by).agg(*(v.alias(k) for k, v in _confusion(F.col("y_score") >= F.col("threshold")).items()))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*by, ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), _f1().alias("f1"), ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"))


def _from_the_top(rows: DataFrame, by) -> DataFrame:
    """Distinct scores with pos and neg: adds tp and fp, both summed from the highest score down, and all_pos and all_neg.

    Sums go by ranges of score first, then within each range, so no task holds a group.
    """
    rows = rows.withColumn("_range", F.coalesce(value_range(F.col("y_score")), F.lit(-(1 << 40))))
    ranges = rows.groupBy(*by, "_range").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    group = Window.partitionBy(*by)
    above = group.orderBy(F.desc("_range"))
    ranges = ranges.select(
        *by, "_range", (F.sum("_pos").over(above) - F.col("_pos")).alias("_tp"), (F.sum("_neg").over(above) - F.col("_neg")).alias("_fp"),
        F.sum("_pos").over(group).alias("all_pos"), F.sum("_neg").over(group).alias("all_neg"),
    )
    down = Window.partitionBy(*by, "_range").orderBy(F.desc("y_score"))
    out = rows.join(ranges, [*by, "_range"]).withColumns({"tp": F.col("_tp") + F.sum("pos").over(down), "fp": F.col("_fp") + F.sum("neg").over(down)})
    return out.drop("_range", "_tp", "_fp")


def _by_score(predictions: DataFrame, by) -> DataFrame:
    rows = predictions.groupBy(*by, "y_score").agg(count_if(F.col("y_true") == 1).alias("pos"), count_if(F.col("y_true") != 1).alias("neg"))
    return _from_the_top(rows, by)


def ranking_metrics(predictions: DataFrame, by=GROUP) -> DataFrame:
    """By group: average precision and area under the ROC curve; null with a single class."""
    c = _by_score(predictions, by)
    ap = F.sum(F.try_divide("pos", "all_pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    roc = F.sum(F.try_divide("neg", "all_neg") * F.try_divide(F.col("tp") - F.col("pos") / 2, F.col("all_pos")))
    both = F.min(F.least("all_pos", "all_neg")) > 0
    return c.groupBy(*by).agg(F.when(both, ap).alias("pr_auc"), F.when(both, roc).alias("roc_auc"))


def warning_metrics(predictions: DataFrame, by=GROUP) -> DataFrame:
    """By group: warning f1 and recall, false alarms by negatives, and mean lead over true positives that have one."""
    pred = F.col("y_pred") == 1
    lead = F.avg(F.when(pred & (F.col("y_true") == 1), F.col("lead_time_sec")))
    c = predictions.groupBy(*by).agg(*(v.alias(k) for k, v in _confusion(pred).items()), lead.alias("avg_lead_time"))
    return c.select(*by, _f1().alias("warning_f1"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("warning_recall"), (F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))).alias("false_alarm_rate"), "avg_lead_time")


def multilabel_metrics(predictions: DataFrame, core, by=("model_name", "task_type")) -> DataFrame:
    """By model and scope (all faults, core faults): macro and micro F1, samples and faults."""
    scopes = F.array(F.lit("all_faults"), F.when(F.col("fault_type").isin(list(core)), F.lit("core_faults")))
    rows = predictions.withColumn("fault_scope", F.explode(F.filter(scopes, lambda s: s.isNotNull())))
    key = [*by, "fault_scope"]
    c = rows.groupBy(*key, "fault_type").agg(*(v.alias(k) for k, v in _confusion(F.col("y_pred") == 1).items()))
    f1 = c.groupBy(*key).agg(F.avg(_f1()).alias("macro_f1"), *(F.sum(x).alias(x) for x in ("tp", "fp", "fn")), F.count("*").alias("fault_count"))
    samples = rows.groupBy(*key).agg(F.countDistinct("sample_id").alias("sample_count"))
    return f1.join(samples, key).select(*key, "macro_f1", _f1().alias("micro_f1"), "sample_count", "fault_count")


def best_thresholds(predictions: DataFrame, by=GROUP[:3], default: float = 0.5, extra=()) -> DataFrame:
    """By group: the threshold of best F1, then recall, then precision, then the lowest.

    Candidates are all distinct finite scores, the default, and those of ``extra`` inside (0, 1).  A single class, or
    no finite score, gives the default.
    """
    finite = predictions.where(F.col("y_score").isNotNull() & ~F.isnan("y_score") & (F.abs("y_score") != float("inf")))
    given = [default, *(x for x in extra if 0 < x < 1)]
    groups = predictions.select(*by).distinct()
    added = groups.select(*by, F.explode(F.array(*map(F.lit, given))).alias("y_score"), F.lit(None).cast("int").alias("y_true"))
    rows = finite.select(*by, F.col("y_score").cast("double").alias("y_score"), F.col("y_true").cast("int").alias("y_true")).unionByName(added)
    c = rows.groupBy(*by, "y_score").agg(count_if(F.col("y_true") == 1).alias("pos"), count_if(F.col("y_true") == 0).alias("neg"))
    c = _from_the_top(c, by).withColumn("fn", F.col("all_pos") - F.col("tp"))
    quality = F.struct(_f1().alias("f1"), ratio(F.col("tp"), F.col("all_pos")).alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), (-F.col("y_score")).alias("low"))
    best = c.groupBy(*by).agg(F.max_by("y_score", quality).alias("_best"), F.max("all_pos").alias("_p"), F.max("all_neg").alias("_n"))
    return best.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_best")).otherwise(F.lit(default)).alias("threshold"))


def apply_thresholds(scores: DataFrame, thresholds: DataFrame, by=GROUP[:3]) -> DataFrame:
    """Scores with threshold and y_pred; the table of thresholds has a row by model, task and fault."""
    return scores.join(thresholds, list(by)).withColumn("y_pred", (F.col("y_score") >= F.col("threshold")).cast("int"))


def wide_to_long(scores: DataFrame, keep, faults, prefix: str = "score_") -> DataFrame:
    """A row by fault from one score column by fault."""
    return scores.unpivot(list(keep), [f"{prefix}{f}" for f in faults], "_name", "y_score").select(*keep, F.expr(f"substring(_name, {len(prefix) + 1})").alias("fault_type"), "y_score")


def rule_baseline(table: DataFrame, rules: dict[str, list[tuple[str, str]]], task: str = "warn") -> DataFrame:
    """The threshold-trend baseline: for each fault the best of a few directed features, scaled by its range in training.

    ``rules`` gives (feature, "high" or "low") by fault; ``table`` has split, y_<task>_<fault>, lead_time_sec and the features.  The
    threshold and the feature are chosen on val by F1, recall and false alarms, the first of equal ones; returns test predictions.
    """
    wanted = [(f, k, c, d) for f, rs in rules.items() for k, (c, d) in enumerate(rs)]
    items = F.array(*(F.struct(F.lit(f).alias("fault_type"), F.lit(k).alias("rule"), F.lit(c).alias("rule_feature"), F.lit(d).alias("rule_direction"), F.col(c).cast("double").alias("x"), F.col(f"y_{task}_{f}").alias("y_true")) for f, k, c, d in wanted))
    rows = table.select("sample_id", "vehicle_id", "split", "lead_time_sec", F.inline(items))
    span = rows.where("split = 'train'").groupBy("fault_type", "rule").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))))).otherwise(F.lit(0.0))
    rows = rows.join(F.broadcast(span), ["fault_type", "rule"]).withColumn("y_score", F.when(F.col("rule_direction") == "high", scaled).otherwise(1 - scaled))
    val = rows.where("split = 'val'")
    found = best_thresholds(val, ("fault_type", "rule"))
    marked = val.join(F.broadcast(found), ["fault_type", "rule"]).withColumn("y_pred", (F.col("y_score") >= F.col("threshold")).cast("int"))
    quality = warning_metrics(marked, ("fault_type", "rule", "threshold"))
    first = F.row_number().over(Window.partitionBy("fault_type").orderBy(F.desc("warning_f1"), F.desc("warning_recall"), "false_alarm_rate", "rule"))
    best = quality.withColumn("_r", first).where("_r = 1").select("fault_type", "rule", "threshold")
    test = rows.where("split = 'test'").join(F.broadcast(best), ["fault_type", "rule"])
    return test.select("sample_id", "vehicle_id", F.lit("threshold_trend").alias("model_name"), F.lit(task).alias("task_type"), "fault_type", "y_true", (F.col("y_score") >= F.col("threshold")).cast("int").alias("y_pred"), "y_score", "threshold", "lead_time_sec", "rule_feature", "rule_direction")


def tree_baseline(table: DataFrame, features: list[str], faults, task: str = "id", trees: int = 10, depth: int = 4) -> DataFrame:
    """One boosted-tree classifier by fault, trained on split train; a fault with one class in training gets that class as its score.

    Training runs many short jobs, so the faults are trained side by side, over rows assembled once; one pass scores all faults.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(table.na.fill(0.0, features))
    target = {f: F.col(f"y_{task}_{f}") for f in faults}
    train = data.where("split = 'train'").select("_x", *target.values()).persist()
    try:
        shares = train.agg(*(F.avg(y.cast("double")).alias(f) for f, y in target.items())).first()
        learned = [f for f in faults if shares[f] not in (None, 0.0, 1.0)]

        def fit(f: str):
            model = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, seed=42).fit(train.select("_x", target[f].cast("double").alias("_y")))
            return model.setProbabilityCol(f"_p_{f}").setRawPredictionCol("").setPredictionCol("")

        with ThreadPoolExecutor(max(1, len(learned))) as pool:
            models = list(pool.map(inheritable_thread_target(table.sparkSession)(fit), learned))
    finally:
        train.unpersist()
    for model in models:
        data = model.transform(data)
    score = {f: F.get(vector_to_array(f"_p_{f}"), F.lit(1)) if f in learned else F.lit(shares[f] or 0.0) for f in faults}
    items = F.array(*(F.struct(F.lit(f).alias("fault_type"), target[f].alias("y_true"), score[f].alias("y_score")) for f in faults))
    return data.select("sample_id", "vehicle_id", "split", F.lit("lightgbm").alias("model_name"), F.lit(task).alias("task_type"), F.inline(items))


def summary(experiment: str, *metrics: DataFrame) -> DataFrame:
    """Metric tables as rows of the 17 summary columns; what a table lacks is null."""
    text = {"experiment_name", *GROUP}
    parts = []
    for m in metrics:
        have = set(m.columns)
        parts.append(m.select(*((F.lit(experiment) if c == "experiment_name" else F.col(c) if c in have else F.lit(None)).cast("string" if c in text else "double").alias(c) for c in SUMMARY)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def only_faults(table: DataFrame, faults) -> DataFrame:
    return table.where(F.col("fault_type").isin(list(faults)))


def acceptance(recognition: DataFrame, warning: DataFrame, ablation: DataFrame) -> DataFrame:
    """One row: whether all three tables have rows."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    one = n(recognition, "a").crossJoin(n(warning, "b")).crossJoin(n(ablation, "c"))
    return one.select(F.expr("a > 0 and b > 0 and c > 0").alias("core_passed"))


def display_name(key: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in DISPLAY.items() for x in kv))
    return F.coalesce(F.try_element_at(names, key), key)


def compare_models(table: DataFrame, metrics: list[str], faults, order: list[str]) -> DataFrame:
    """By model on the test split: faults and mean metrics, with display name and place in ``order``."""
    rows = only_faults(table, faults).where("split = 'test'")
    out = rows.groupBy(F.col("model_name").alias("model_key")).agg(F.countDistinct("fault_type").alias("fault_count"), *(F.avg(m).alias(m) for m in metrics))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model_key")).cast("int")
    return out.withColumns({"model_name": display_name(F.col("model_key")), "place": F.when(place > 0, place).otherwise(len(order) + 1)})


def metric_bars(comparison: DataFrame, category: str, metrics: list[str]) -> DataFrame:
    """Long form (series, category, value) without nulls."""
    return comparison.unpivot([category], metrics, "series", "value").where("value is not null").select(F.lit("bar_metric").alias("plot_type"), "series", F.col(category).alias("category"), "value")


def best_by_metric(comparison: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, model_key, value) of the best model; of equal ones the first name."""
    long = comparison.unpivot(["model_key"], metrics, "metric", "value").where("value is not null")
    first = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "model_key"))
    return long.withColumn("_r", first).where("_r = 1").drop("_r")


def confusion_rates(binary: DataFrame, warning: DataFrame, by=GROUP) -> DataFrame:
    """(group, rate, value): TPR, FNR, FPR and TNR."""
    both = binary.select(*by, "recall").join(warning.select(*by, "false_alarm_rate"), list(by))
    rates = both.withColumns({"TPR": F.col("recall"), "FNR": 1 - F.col("recall"), "FPR": F.col("false_alarm_rate"), "TNR": 1 - F.col("false_alarm_rate")})
    return rates.unpivot(list(by), ["TPR", "FNR", "FPR", "TNR"], "rate", "value")


def ablation(comparison: DataFrame, base: str, metrics: list[str]) -> DataFrame:
    """Each model's metrics and how far the base model is above them."""
    one = comparison.where(F.col("model_key") == base).select(*(F.col(m).alias(f"base_{m}") for m in metrics))
    return comparison.crossJoin(F.broadcast(one)).select("model_key", *metrics, *((F.col(f"base_{m}") - F.col(m)).alias(f"delta_{m}") for m in metrics))


def model_deltas(left: DataFrame, right: DataFrame, metrics: list[str]) -> DataFrame:
    """Two comparison tables side by side, left join on the model, with differences."""
    other = right.select("model_key", *(F.col(m).alias(f"other_{m}") for m in metrics))
    return left.join(other, "model_key", "left").select("model_key", *metrics, *((F.col(m) - F.col(f"other_{m}")).alias(f"delta_{m}") for m in metrics))


def lead_times(predictions: DataFrame) -> DataFrame:
    """By fault: count, mean and quartiles of the lead of true positives."""
    hits = predictions.where("y_true = 1 and y_pred = 1 and lead_time_sec is not null")
    q = F.percentile("lead_time_sec", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return hits.groupBy("fault_type").agg(F.count("*").alias("n"), F.avg("lead_time_sec").alias("mean"), q.alias("q")).select("fault_type", "n", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
