"""Queries of the telemetry operators over tables derived from events and embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sensors as S
from ..operators import clean, events, features, labels, profiles, splits, windows
from ..sources import telemetry
from ..sources.shared import Scratch, fresh_path, shared_dir
from ..streaming import fleet as streaming
from . import fixtures as X
from . import oracle as O
from .registry import Query

_FAULTS = S.FAULTS
_W = "PARTITION BY vehicle_id ORDER BY frame_index"
_KEY = "vehicle_id:s frame_index:i"
_LABEL = f"{_KEY} label:i"


def _san(column: str, source: str = "frames", into: str = "san") -> str:
    """Sanitized arrays in SQL (no non-finite items occur in the derived frames)."""
    return f"""{into}_c AS (SELECT vehicle_id, c, median(CASE WHEN x <> 0 THEN x END) AS m, max(abs(x)) AS a FROM (SELECT vehicle_id, unnest({column}) AS x, unnest(range(1, len({column}) + 1)) AS c FROM {source}) GROUP BY 1, 2),
{into}_v AS (SELECT vehicle_id, list(coalesce(m, 0) ORDER BY c) AS ms, CASE WHEN max(a) > 1000 THEN 1000.0 ELSE 1.0 END AS u FROM {into}_c GROUP BY 1),
{into} AS (SELECT vehicle_id, frame_index, charge_status, list_transform({column}, lambda x, i: (CASE WHEN x = 0 THEN ms[i] ELSE x END) / u) AS v FROM {source} JOIN {into}_v USING (vehicle_id))"""


_CELL = "cell AS (SELECT vehicle_id, frame_index, unnest(v) AS x, unnest(range(0, len(v))) AS c FROM san)"
_INS = f"""{O.FRAMES}, i0 AS (SELECT vehicle_id, frame_index, charge_status AS s, insulation_resistance AS r, row_number() OVER ({_W}) - 1 AS i,
 count(*) OVER (PARTITION BY vehicle_id) AS n, lag(charge_status) OVER ({_W}) AS p, lead(charge_status) OVER ({_W}) AS q FROM frames),
i1 AS (SELECT *,
 CASE WHEN s IN (1, 2) THEN CAST(r < 41 AS INT) WHEN i >= 2 AND i + 2 <= n AND coalesce(p IN (1, 2) OR q IN (1, 2), false) AND r > 41 THEN 0 ELSE CAST(r < 205 AS INT) END AS base,
 max(r) OVER (PARTITION BY vehicle_id) - min(r) OVER (PARTITION BY vehicle_id) AS rng FROM i0),
i2 AS (SELECT *, coalesce(base = 1 AND abs(lead(r) OVER ({_W}) - r) < CAST(0.003 AS DOUBLE) * rng, false) AS a FROM i1),
i3 AS (SELECT *, CASE WHEN a AND NOT coalesce(lag(a) OVER ({_W}), false) THEN i END AS o FROM i2),
i4 AS (SELECT *, a AND (i - max(o) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) % 2 = 0 AS g FROM i3),
ins AS (SELECT vehicle_id, frame_index, CAST(base = 1 OR coalesce(lag(g) OVER ({_W}), false) AS INT) AS label FROM i4)"""


def _events_sql(source: str, head: str) -> str:
    """Events of (vehicle_id, fault_type, frame_index, label) rows."""
    w = "PARTITION BY vehicle_id, fault_type ORDER BY frame_index"
    return f"""{head}, e0 AS (SELECT *, row_number() OVER ({w}) AS i FROM ({source})), e1 AS (SELECT *, i - row_number() OVER ({w}) AS isl FROM e0
 WHERE label = 1),
e2 AS (SELECT vehicle_id, fault_type, isl, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS duration_frames FROM e1 GROUP BY ALL),
evt AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, fault_type ORDER BY start_frame) AS event_id, duration_frames * 10 AS duration_seconds FROM e2)"""


_LONG = " UNION ALL ".join(f"SELECT vehicle_id, '{f}' AS fault_type, frame_index, label_final_{f} AS label FROM fin" for f in _FAULTS)
_EVT = _events_sql(_LONG, O.FINAL_LABELS)
_EVENT = "vehicle_id:s fault_type:s event_id:i start_frame:i end_frame:i duration_frames:i duration_seconds:i"
_TARGETS = [f"y_{k}_{f}" for k in ("id", "warn") for f in _FAULTS]
_SAMPLE = "sample_id:s vehicle_id:s segment_id:i start_time:i end_time:i start_frame:i end_frame:i quality_flag:s " + " ".join(f"{t}:i" for t in _TARGETS) + " future_first_fault:s lead_time_sec:i"


def insulation_events(spark: SparkSession, d: str) -> DataFrame:
    """Which vehicles had insulation failures, how many, how long: rule, gap merging, events, summary."""
    rows = events.merge_short_gaps(labels.insulation(X.frames(spark, d)), "label", "merged")
    found = events.extract_events(rows.select("vehicle_id", "frame_index", F.lit("ins").alias("fault_type"), F.col("merged").alias("label")))
    return found.groupBy("vehicle_id").agg(F.count("*").alias("events"), F.sum("duration_frames").alias("frames"), F.max("duration_seconds").alias("longest_seconds"))


def _samples(s: SparkSession, d: str) -> DataFrame:
    return splits.with_splits(X.samples(s, d), X.split_map(s, d))


def _features(s: SparkSession, d: str, icc: bool = False) -> DataFrame:
    return features.window_features(X.frames(s, d), X.samples(s, d), X.WINDOW, icc)


def _raw(s: SparkSession, d: str) -> DataFrame:
    return X.raw_frames(s, d).withColumn("voltages", S.parse_series(F.col("batteryvoltage")))


def _normalized(s: SparkSession, d: str) -> DataFrame:
    """Parsed voltages, written once as three passes read them, brought to the usual length."""
    rows = Scratch(s).keep(_raw(s, d).select("vehicle_id", "frame_index", "voltages"), "voltages")
    return clean.normalize_sensors(rows, "voltages", "ok")


_RAWV = f"""{O.FRAMES}, rv0 AS (SELECT *, array_to_string(list_transform(voltages, lambda x: printf('%.4f', x)), '~') AS v FROM frames),
 rv1 AS (SELECT vehicle_id, frame_index, event_id,
 CASE WHEN event_id % 23 = 0 THEN array_to_string(string_split(v, '~')[1:15], '~') WHEN event_id % 29 = 0 THEN v || '~9.9' WHEN event_id % 31 = 0 THEN '' WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 'bad~' || array_to_string(string_split(v, '~')[2:16], '~') ELSE v END AS t
 FROM rv0),
rv AS (SELECT *,
 CASE WHEN t IS NULL THEN [CAST(0 AS DOUBLE)] ELSE list_transform(list_filter(string_split(t, '~'), lambda x: x <> ''), lambda x: coalesce(TRY_CAST(x AS DOUBLE), 0)) END AS a
 FROM rv1)"""
_NORM = f"""{_RAWV}, nl AS (SELECT vehicle_id, len(a) AS n, count(*) AS c, min(frame_index) AS f FROM rv WHERE len(a) > 0 GROUP BY 1, 2),
 nu AS (SELECT vehicle_id, first(n ORDER BY c DESC, f) AS u FROM nl GROUP BY 1),
nf AS (SELECT rv.*, u, CASE WHEN len(a) = 0 THEN NULL WHEN len(a) >= u THEN a[1:u] ELSE list_concat(a,
 list_transform(range(u - len(a)), lambda i: a[-1])) END AS fit FROM rv JOIN nu USING (vehicle_id)),
norm AS (SELECT *, coalesce(last_value(fit IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 list_transform(range(u), lambda i: CAST(0 AS DOUBLE))) AS v, len(a) = u AND len(a) > 0 AS ok FROM nf)"""
_SCALARS = f"""{O.FRAMES}, sc AS (SELECT *, list_max(voltages) - list_min(voltages) AS v_range, list_max(temperatures) - list_min(temperatures) AS t_range,
 list_median(voltages) AS med, list_min(voltages) AS v_min, list_max(temperatures) AS t_max, list_position(voltages, list_min(voltages)) - 1 AS weak_cell,
 list_sum(voltages) AS v_sum,
 list_max(list_transform(range(1, len(voltages)), lambda i: abs(voltages[i + 1] - voltages[i]))) AS gap FROM frames)"""
FEATURES = f"""{_SCALARS}, {O.SAMPLES.replace(O.EVENTS + ', ', '')}, sp AS (SELECT *, lag(voltages) OVER ({_W}) AS pv, v_min - med AS weak, v_min - lag(v_min) OVER ({_W}) AS dv, t_max - lag(t_max) OVER ({_W}) AS dt FROM sc),
sd AS (SELECT *, CASE WHEN pv IS NULL THEN [] ELSE list_transform(range(1, 17), lambda i: abs(voltages[i] - pv[i])) END AS ch,
 list_transform(voltages, lambda x: abs(x - med)) AS off FROM sp),
fe AS (SELECT *, list(weak_cell) OVER w AS wk, list(insulation_resistance) OVER w AS rs, max(v_range) OVER w AS f_vr, max(t_range) OVER w AS f_tr,
 min(weak) OVER w AS f_wmin, weak - first_value(weak) OVER w AS f_wslope, v_min - first_value(v_min) OVER w AS f_drop, min(dv) OVER x AS f_dv,
 max(t_max) OVER w AS f_tmax, max(dt) OVER x AS f_dt,
 max(list_max(ch)) OVER x AS f_ch, max(gap) OVER w AS f_gap, sum(len(list_filter(ch, lambda c: c > 0.015))) OVER x / CAST(80 AS DOUBLE) AS f_steep,
 sum(list_sum(off)) OVER w / CAST(96 AS DOUBLE) AS f_off, sum(len(list_filter(ch, lambda c: c > 0.05))) OVER x AS f_jump,
 avg(sum_voltage - v_sum) OVER w AS f_pack,
 sum(len(list_filter(off, lambda c: c > 0.03))) OVER w / CAST(96 AS DOUBLE) AS f_offc,
 min(insulation_resistance) OVER w AS f_rmin, insulation_resistance - first_value(insulation_resistance) OVER w AS f_rslope, insulation_resistance - CASE WHEN charge_status IN (1, 2) THEN 100 ELSE 500 END * sum_voltage AS f_margin
 FROM sd WINDOW w AS ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), x AS ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
feat AS (SELECT sample_id, fe.charge_status AS shared_charge_status, soc AS shared_soc, speed AS shared_speed, sum_voltage AS shared_sum_voltage, sum_current AS shared_sum_current, insulation_resistance AS shared_insulation_resistance, f_vr AS shared_v_range, f_tr AS shared_t_range, f_wmin AS sd_cell_dev_min, f_wslope AS sd_cell_dev_slope,
 list_max(list_transform(wk, lambda c: len(list_filter(wk, lambda y: y = c)))) / CAST(6 AS DOUBLE) AS sd_weak_cell_repeat_ratio, f_drop AS sd_rest_drop_rate, f_dv AS isc_module_vdrop_max, f_vr AS isc_module_vrange, f_tmax AS isc_module_tmax, f_dt AS isc_module_trise_max, coalesce(f_ch, 0) AS conn_dvdt_max, f_gap AS conn_neighbor_response_gap, f_steep AS conn_abnormal_point_ratio,
 f_off AS samp_local_median_residual, f_jump AS samp_sensor_jump_count, f_pack AS samp_pack_sum_residual, f_offc AS samp_abnormal_count_ratio, f_rmin AS ins_rins_min, f_rslope AS ins_rins_slope, f_margin AS ins_threshold_margin, len(list_filter(rs, lambda y: y < list_median(rs))) AS ins_low_rins_persistence
 FROM fe JOIN samples ON samples.vehicle_id = fe.vehicle_id AND end_frame = fe.frame_index)"""


def _fcols(prefix: str) -> str:
    names = {
        "shared": "charge_status soc speed sum_voltage sum_current insulation_resistance v_range t_range", "sd": "cell_dev_min cell_dev_slope weak_cell_repeat_ratio rest_drop_rate", "isc": "module_vdrop_max module_vrange module_tmax module_trise_max",
        "conn": "dvdt_max neighbor_response_gap abnormal_point_ratio", "samp": "local_median_residual sensor_jump_count pack_sum_residual abnormal_count_ratio", "ins": "rins_min rins_slope threshold_margin low_rins_persistence",
    }
    return "sample_id:s " + " ".join(f"{prefix}_{n}:d4" for n in names[prefix].split())


_PROFILE = f"""{O.SAMPLES}, prof AS (SELECT vehicle_id, count(*) AS window_count, {', '.join(f'sum({t}) AS {t}_positive' for t in _TARGETS)}, {" || '|' || ".join(f"CASE WHEN sum(y_id_{f}) > 0 THEN '1' ELSE '0' END" for f in _FAULTS)} AS fault_vector FROM samples GROUP BY 1)"""
_SUMS = ", ".join(f"sum({t}) AS {t}" for t in _TARGETS)
_POS = " OR ".join(f"{t} = 1" for t in _TARGETS)


def _regrouped(s: SparkSession, d: str, vehicles: int) -> DataFrame:
    """The windows of all users as those of so many vehicles."""
    n = (F.substring("vehicle_id", 2, 20).cast("long") * 7 + F.floor(F.col("start_frame") / 3)) % vehicles
    return windows.window_profile(X.samples(s, d).withColumn("vehicle_id", F.concat(F.lit("G"), F.lpad(n.cast("string"), 2, "0"))))


def _regrouped_sql(vehicles: int) -> str:
    name = f"'G' || lpad(CAST((CAST(vehicle_id[2:] AS BIGINT) * 7 + start_frame // 3) % {vehicles} AS VARCHAR), 2, '0')"
    return _PROFILE.replace("FROM samples GROUP BY 1", f"FROM (SELECT * REPLACE ({name} AS vehicle_id) FROM samples) GROUP BY 1")


def _splits(s: SparkSession, d: str) -> DataFrame:
    """The search at its usual size: 12 vehicles to train, 4 each to val and test."""
    return splits.assign_splits(_regrouped(s, d, 20))


def _greedy(s: SparkSession, d: str) -> DataFrame:
    return splits.greedy_splits(windows.window_profile(X.samples(s, d)), 20, 20)


def _covers(s: SparkSession, d: str) -> DataFrame:
    """What a split of a hundred vehicles made of all users, 20 to test and 20 to val, covers."""
    shared_dir(s)  # checkpoints need a folder
    profile = _regrouped(s, d, 100).checkpoint()
    dealt = splits.assign_splits(profile, profile.count() - 40, 20, 20).join(splits._vehicles(profile, splits.CORE).withColumnRenamed("id", "vehicle_id"), "vehicle_id")
    has = lambda names, c: F.bit_or(F.when(F.col("split").isin(*names), F.col(c)).otherwise(0))
    full = [(has([p], f"{kind}_mask") == 7).alias(f"{p}_{kind}") for kind, of in (("id", splits.SPLITS), ("warn", splits.SPLITS[:2])) for p in of]
    rare = [(has(["test", "val"], "rare_isc") > 0).alias("isc_eval"), (has(["train"], "rare_isc") > 0).alias("isc_train"), (has(["test", "val"], "rare_conn") > 0).alias("conn_eval")]
    sizes = [F.sum((F.col("split") == p).cast("int")).alias(f"n_{p}") for p in splits.SPLITS]
    return dealt.agg(*full, *rare, F.bit_count(has(["train"], "id_mask")).alias("train_faults"), *sizes)


_CORE = ("sd", "samp", "ins")
_BITS = lambda k: " + ".join(f"CASE WHEN y_{k}_{f}_positive > 0 THEN {1 << i} ELSE 0 END" for i, f in enumerate(_CORE))
_VEHICLES = f"""ve AS (SELECT vehicle_id AS id, window_count AS windows, {_BITS('id')} AS id_mask, {_BITS('warn')} AS warn_mask, {' + '.join(f'y_id_{f}_positive' for f in _CORE)} AS id_total,
 {' + '.join(f'y_warn_{f}_positive' for f in _CORE)} AS warn_total, CAST(y_id_isc_positive > 0 AS INT) AS rare_isc,
 CAST(y_id_conn_positive > 0 AS INT) AS rare_conn FROM prof)"""
_FOUR = lambda op, c: f" {op} ".join(f"{v}.{c}" for v in "abcd")
_SEARCH = f"""{_VEHICLES}, sub AS (SELECT [a.id, b.id, c.id, d.id] AS ids, {', '.join(f"{_FOUR('+', c)} AS {c}" for c in ("windows", "id_total", "warn_total"))},
 {', '.join(f"{_FOUR('|', c)} AS {c}" for c in ("id_mask", "warn_mask", "rare_isc", "rare_conn"))} FROM ve a JOIN ve b ON a.id < b.id JOIN ve c ON b.id < c.id
 JOIN ve d ON c.id < d.id),
top AS (SELECT * FROM sub
 ORDER BY id_mask = 7 DESC, warn_mask = 7 DESC, bit_count(CAST(id_mask AS INT)) DESC, bit_count(CAST(warn_mask AS INT)) DESC, rare_isc + rare_conn DESC, id_total DESC, warn_total DESC, windows DESC, ids LIMIT 800),
two AS (SELECT t.ids AS t_ids, v.ids AS v_ids, t.id_mask = 7 AS t1, v.id_mask = 7 AS v1, t.warn_mask = 7 AS t2, v.warn_mask = 7 AS v2, t.rare_isc | v.rare_isc AS e_isc, t.rare_conn | v.rare_conn AS e_conn,
 t.warn_total + v.warn_total AS warn2, t.windows + v.windows AS windows2, t.id_total + v.id_total AS total2 FROM top t
 JOIN top v ON NOT list_has_any(t.ids, v.ids)),
full3 AS (SELECT two.*, bit_or(id_mask) AS r_mask, sum(ve.id_total) AS r_total, max(rare_isc) AS r_isc FROM two
 JOIN ve ON NOT list_contains(t_ids, id) AND NOT list_contains(v_ids, id) GROUP BY ALL),
have AS (SELECT sum(rare_isc) AS n_isc, sum(rare_conn) AS n_conn FROM ve),
one AS (SELECT t_ids, v_ids FROM full3, have
 ORDER BY t1 DESC, v1 DESC, r_mask = 7 DESC, t2 DESC, v2 DESC, n_isc >= 2 AND r_isc > 0 AND e_isc > 0 DESC, n_isc > 0 AND r_isc > 0 DESC, n_isc > 0 AND e_isc > 0 DESC, n_conn > 0 AND e_conn > 0 DESC,
 bit_count(CAST(r_mask AS INT)) DESC, total2 + r_total DESC, warn2 DESC, windows2 DESC, t_ids, v_ids LIMIT 1)"""
#: Every cover that twenty vehicles each in test and val, and the rest in train, can have: a class of faults after the other, each giving a vehicle to none or some of them.
_COVERS = f"""{_VEHICLES}, cl AS (SELECT row_number() OVER (ORDER BY id_mask, warn_mask, rare_isc, rare_conn) AS k, * FROM (SELECT id_mask, warn_mask, rare_isc, rare_conn, count(*) AS n FROM ve
 GROUP BY ALL)),
dp AS (SELECT 0 AS k, 0 AS ti, 0 AS tw, 0 AS vi, 0 AS vw, 0 AS ri, 0 AS ei, 0 AS ec, 0 AS rr UNION SELECT dp.k + 1, ti | (t * id_mask), tw | (t * warn_mask), vi | (v * id_mask), vw | (v * warn_mask), ri | (r * id_mask),
 ei | ((t | v) * rare_isc), ec | ((t | v) * rare_conn), rr | (r * rare_isc) FROM dp JOIN cl ON cl.k = dp.k + 1 JOIN (SELECT p & 1 AS t, (p >> 1) & 1 AS v, p >> 2 AS r FROM range(8) x(p)) o
 ON t + v + r <= n),
have AS (SELECT sum(rare_isc) AS n_isc, sum(rare_conn) AS n_conn, count(*) AS n FROM ve),
one AS (SELECT dp.*, n FROM dp, have WHERE k = (SELECT max(k) FROM cl)
 ORDER BY ti = 7 DESC, vi = 7 DESC, ri = 7 DESC, tw = 7 DESC, vw = 7 DESC, n_isc >= 2 AND rr > 0 AND ei > 0 DESC, rr DESC, ei DESC, ec DESC, bit_count(CAST(ri AS INT)) DESC LIMIT 1)"""
_DRAW = lambda c: f"md5('42:' || {c})"


def _downsampled(s: SparkSession, d: str) -> DataFrame:
    return splits.downsample(_samples(s, d), "train", 400)


def _with_issues(s: SparkSession, d: str) -> DataFrame:
    """Samples where val has no warnings of sd and no sampling faults, and test no rare faults."""
    none = lambda split, c: F.when(F.col("split") == split, 0).otherwise(F.col(c)).alias(c)
    lost = {c: none("val", c) for c in ("y_warn_sd", "y_id_samp")} | {c: none("test", c) for c in ("y_id_isc", "y_warn_conn")}
    return _samples(s, d).withColumns(lost)


def _consistency(s: SparkSession, d: str) -> DataFrame:
    """Against a map without every tenth vehicle and with every eleventh in another split."""
    n = F.substring("vehicle_id", 2, 20).cast("long")
    mapping = X.split_map(s, d).where(n % 10 != 0).withColumn("split", F.when(n % 11 == 0, "other").otherwise(F.col("split")))
    return splits.consistency_issues(_samples(s, d), mapping)


def _completeness(s: SparkSession, d: str) -> DataFrame:
    x = X.samples(s, d)
    k = F.col("end_frame") % 7
    tensors = x.where(k != 0).unionByName(x.where(k == 1)).select("sample_id")
    return windows.completeness(x, tensors)


def _csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Frames written as wide csv, a folder by vehicle, under four headers (in another order, with fewer cells, without optional columns), read back in one call."""
    root, rows = fresh_path(s, "csv"), X.frames(s, d)
    cells = lambda k: [F.col("voltages")[i].alias(f"U_{i + 1}") for i in range(k)]
    probes = [F.col("temperatures")[i].alias(f"T_{i + 1}") for i in range(X.PROBES)]
    must, more = [F.col("timestamp").alias("TIME"), F.col("charge_status").alias("CHARGE_STATUS")], [F.col("soc").alias("SOC"), F.col("speed").alias("SPEED")]
    of = F.substring("vehicle_id", 2, 20).cast("int") % 4
    kinds = (must + more + cells(16) + probes, probes[::-1] + cells(16)[::-1] + more + must, must + cells(12) + more[:1] + probes, cells(16) + must[::-1] + probes[:4])
    telemetry.write_csv_tree(rows, root, {str(k): (of == k, columns) for k, columns in enumerate(kinds)})
    out = telemetry.read_structured(s, root, "folder").withColumn("vehicle_id", F.regexp_replace("vehicle_id", "^vehicle_id=", ""))
    return out.select("vehicle_id", "frame_index", "charge_status", F.size("voltages").alias("cells"), F.element_at("voltages", 10).alias("v10"), F.element_at("voltages", -1).alias("v_last"), F.size("temperatures").alias("probes"), F.array_max("temperatures").alias("t_max"), "soc", "speed")


def _manifest(s: SparkSession, d: str) -> DataFrame:
    """One csv by vehicle in a directory of its own, listed as a raw tree."""
    root = fresh_path(s, "tree")
    rows = X.raw_labels(s, d).select(F.col("vehicle_id").alias("vin"), "frame_index", "timestamp")
    telemetry.write_csv_tree(rows, root, {"raw": (F.lit(True), ["frame_index", "timestamp"])}, "vin")
    out = telemetry.scan_files(s, None, root)
    return out.select(F.regexp_replace("vehicle_id", "^vin=", "").alias("vehicle_id"), "source_dataset", "is_extracted", "entry_kind")


def _raw_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Raw rows with damaged series written as csv, a folder by vehicle, under three headers (in another order, without insulation), and read back in one call."""
    root = fresh_path(s, "raw")
    rows = X.raw_frames(s, d).withColumn("soc", (F.col("event_id") % 101).cast("double"))
    names = ["terminaltime", "chargestatus", "batteryvoltage", "probetemperatures", "insulationresistance"]
    of = F.substring("vehicle_id", 2, 20).cast("int") % 3
    telemetry.write_csv_tree(rows, root, {str(k): (of == k, columns) for k, columns in enumerate((names, ["soc", *names[::-1]], ["soc", *names[:-1]]))})
    out = telemetry.read_raw(s, root, "folder").withColumn("vehicle_id", F.regexp_replace("vehicle_id", "^vehicle_id=", ""))
    return out.select("vehicle_id", "frame_index", F.size("voltages").alias("items"), F.array_max("voltages").alias("v_max"), F.size("temperatures").alias("probes"), F.col("insulation_resistance").alias("r"), "soc", F.col("insulation_given").alias("given"))


def _missing_columns(s: SparkSession, d: str) -> DataFrame:
    """The columns that the readers name as missing in a file without two of them."""
    rows = X.raw_frames(s, d).select(F.col("terminaltime"), F.col("chargestatus"))
    found = []
    for form in ("raw", "structured"):
        try:
            telemetry.require_columns(rows, telemetry.REQUIRED[form])
        except ValueError as e:
            found.append(F.struct(F.lit(form).alias("form"), F.lit(str(e)).alias("message")))
    return rows.agg(F.count("*").alias("rows")).select("rows", F.inline(F.array(*found)))


def _by_ending(s: SparkSession, d: str) -> DataFrame:
    """Events written as csv, tab-separated text, json lines and Parquet, read back by ending."""
    root, rows = fresh_path(s, "endings"), X.table(s, d, "events").select("event_id", "event_type", "value")
    rows.write.option("header", True).csv(f"{root}/e.csv")
    rows.write.option("header", True).option("sep", "\t").csv(f"{root}/e.tsv")
    rows.write.json(f"{root}/e.json")
    rows.write.parquet(f"{root}/e.parquet")
    parts = [telemetry.read_dataset(s, f"{root}/e.{x}").select(F.lit(x).alias("ending"), "event_id", "event_type", "value") for x in ("csv", "tsv", "json", "parquet")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _stream(s: SparkSession, slices: list[DataFrame], build) -> DataFrame:
    """Runs ``build`` as a file stream that takes up the slices one after the other, from its checkpoint each time; a slice is one batch, and no batch is without rows."""
    root = fresh_path(s, "stream")
    conf = {"stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "noDataMicroBatches.enabled": "false"}
    conf = {f"spark.sql.streaming.{k}": x for k, x in conf.items()}
    before = {k: s.conf.get(k, None) for k in conf}
    for k, x in conf.items():
        s.conf.set(k, x)
    try:
        for rows in slices:
            rows.write.mode("append").parquet(f"{root}/in")
            out = build(s.readStream.schema(slices[0].schema).parquet(f"{root}/in"))
            out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    finally:
        for k, x in before.items():
            s.conf.unset(k) if x is None else s.conf.set(k, x)
    return s.read.schema(out.schema).parquet(f"{root}/out")


def _by_time(rows: DataFrame, closing, gap: int) -> tuple[list[DataFrame], int]:
    """Three slices of time of ``rows`` (with ts), then rows that ``closing`` makes of times far behind them, which move the watermark past all; and the span in seconds."""
    low, high = rows.agg(F.min(F.col("ts").cast("long")), F.max(F.col("ts").cast("long"))).first()
    part = F.floor((F.col("ts").cast("long") - low) * 3 / (high - low + 1))
    later = [closing(F.timestamp_seconds(F.lit(high + k * (gap + 2 * (high - low + 1))))) for k in (1, 2)]
    return [rows.where(part == k) for k in range(3)] + later, high - low + 1


def _stream_events(s: SparkSession, d: str) -> DataFrame:
    """Three slices of time, within which rows come in any order; vehicles end without a mark, and only the rows of another vehicle tell that they are silent."""
    faults = {f: f"label_raw_{f}" for f in _FAULTS}
    frames = X.label_rows(s, d).select("vehicle_id", "frame_index", F.timestamp_seconds("timestamp").alias("ts"), *faults.values())
    frames = Scratch(s).keep(frames, "frames")  # read once a slice
    closing = lambda ts: s.range(1).select(F.lit("").alias("vehicle_id"), F.lit(0).alias("frame_index"), ts.alias("ts"), *(F.lit(0).alias(n) for n in faults.values()))
    slices, span = _by_time(frames, closing, 1200)
    buckets = max(64, frames.count() // 10_000)
    return _stream(s, slices, lambda r: streaming.stream_events(r, silence=span, buckets=buckets, faults=faults))


_SEGMENT_ROWS = f"""{O.RAW_LABELS}, sg AS (SELECT vehicle_id, segment_id, count(*) AS rows, min(timestamp) AS start_seconds, max(timestamp) AS end_seconds
 FROM raw GROUP BY 1, 2)"""


def _stream_segments(s: SparkSession, d: str) -> DataFrame:
    """Three slices of time, and a later row of another vehicle, twice, that moves the watermark past all sessions."""
    rows = X.label_rows(s, d).select("vehicle_id", F.timestamp_seconds("timestamp").alias("ts"))
    slices, _ = _by_time(rows, lambda ts: s.range(1).select(F.lit("").alias("vehicle_id"), ts.alias("ts")), 10 * X.MAX_GAP)
    found = _stream(s, slices, lambda r: streaming.stream_segments(r, X.MAX_GAP)).where("vehicle_id <> ''")
    return found.select("vehicle_id", "rows", F.col("start_time").cast("long").alias("start_seconds"), F.col("end_time").cast("long").alias("end_seconds"))


def _bucketed(s: SparkSession, d: str) -> DataFrame:
    """Frames and labels written as tables in buckets of the vehicle, run through a window of the vehicle, which needs no exchange, and joined by (vehicle, frame)."""
    both, buckets = [], telemetry.bucket_count(X.table(s, d, "events").count())
    for kind, df in (("frames", X.frames(s, d).select("vehicle_id", "frame_index", "soc")), ("labels", X.raw_labels(s, d).select("vehicle_id", "frame_index", "label_raw_sd"))):
        root = fresh_path(s, kind)
        both.append(telemetry.write_bucketed(df, root.rsplit("/", 1)[-1].replace("-", "_"), buckets, path=root))
    w = Window.partitionBy("vehicle_id").orderBy("frame_index")
    return both[0].withColumn("change", F.col("soc") - F.lag("soc").over(w)).join(both[1], ["vehicle_id", "frame_index"])


def _pack(s: SparkSession, d: str) -> DataFrame:
    """Every cell of the training pack, a row each: its part, its two places in it, its value."""
    pack = features.dataset_pack(X.frames(s, d), X.samples(s, d), X.WINDOW)
    cells = lambda part: F.transform(part, lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("i"), F.lit(0).alias("j"), x.cast("double").alias("value")))
    steps = F.flatten(F.transform("x_seq", lambda row, i: F.transform(row, lambda x, j: F.struct(F.lit("x_seq").alias("part"), i.alias("i"), j.alias("j"), x.cast("double").alias("value")))))
    return pack.select("sample_id", F.inline(F.concat(steps, cells("x_feat"), cells("y_id"), cells("y_warn"))))


def _frames_san(s: SparkSession, d: str) -> DataFrame:
    """Sanitized voltages of frames with some zeros."""
    df = X.frames(s, d).withColumn("voltages", F.when(F.col("event_id") % 19 == 0, F.transform("voltages", lambda x, i: F.when(i == 3, F.lit(0.0)).otherwise(x))).otherwise(F.col("voltages")))
    return clean.sanitize(df, "voltages").select("vehicle_id", "frame_index", F.element_at("voltages", 4).alias("v4"), S.array_sum(F.col("voltages")).alias("v_sum"))


_ZEROED = "zf AS (SELECT * REPLACE (CASE WHEN event_id % 19 = 0 THEN list_transform(voltages, lambda x, i: CASE WHEN i = 4 THEN CAST(0 AS DOUBLE) ELSE x END) ELSE voltages END AS voltages) FROM frames)"
_LBL3 = f"""{O.FRAMES}, {_san('voltages')}, dl0 AS (SELECT *, lag(v) OVER ({_W}) AS pv FROM san), dl AS (SELECT vehicle_id, frame_index,
 CASE WHEN pv IS NULL THEN list_transform(v, lambda x: CAST(0 AS DOUBLE)) ELSE list_transform(range(1, 17), lambda i: (v[i] - pv[i]) / 10) END AS dd FROM dl0),
pr AS (SELECT vehicle_id, unnest(dd[1:15]) AS a, unnest(dd[2:16]) AS b, unnest(range(15)) AS cell FROM dl), pm AS (SELECT vehicle_id, cell,
 count(*) AS n, (sum(a) + sum(b)) / (2 * count(*)) AS m FROM pr GROUP BY 1, 2),
pi AS (SELECT vehicle_id, cell,
 CASE WHEN sum((a - m) * (a - m)) + sum((b - m) * (b - m)) = 0 THEN 1 ELSE sum((a - m) * (b - m)) / (max(n) * ((sum((a - m) * (a - m)) + sum((b - m) * (b - m))) / (2 * max(n)))) END AS icc
 FROM pr JOIN pm USING (vehicle_id, cell) GROUP BY 1, 2)"""
_CONN = f"""{_LBL3}, cc AS (SELECT vehicle_id, c, count(*) AS k FROM (SELECT vehicle_id, unnest([cell, cell + 1]) AS c FROM pi WHERE icc < 0.8) GROUP BY 1, 2),
 cs AS (SELECT vehicle_id, list(c) AS s FROM (SELECT *, max(k) OVER (PARTITION BY vehicle_id) AS mk FROM cc) WHERE k > 1 OR mk < 2 GROUP BY 1),
cx AS (SELECT vehicle_id, max(list_max(list_transform(dd, lambda x: abs(x)))) AS mx, count(*) AS n FROM dl GROUP BY 1),
conn AS (SELECT dl.vehicle_id, frame_index,
 CAST(coalesce(mx > 0 AND n > 1 AND len(list_filter(s, lambda c: abs(dd[c + 1]) / mx >= 0.7)) > 0, false) AS INT) AS label FROM dl JOIN cx USING (vehicle_id)
 LEFT JOIN cs USING (vehicle_id))"""
_SAMP = f"""{O.FRAMES}, {_san('voltages')}, so AS (SELECT vehicle_id, frame_index, list_transform(v, lambda x: x - list_median(v)) AS o FROM san
 WHERE charge_status = 3), sl AS (SELECT vehicle_id, frame_index, unnest(o) AS x, unnest(range(16)) AS c FROM so),
ssum AS (SELECT *, sum(x) OVER (PARTITION BY vehicle_id, c ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s FROM sl),
 sq AS (SELECT vehicle_id, c, quantile_cont(s, 0.05) AS p5, quantile_cont(s, 0.95) AS p95, count(*) AS n FROM ssum GROUP BY 1, 2),
sb AS (SELECT vehicle_id, quantile_cont(p5, 0.05) AS lo, quantile_cont(p95, 0.95) AS hi, max(n) AS n FROM sq GROUP BY 1 HAVING max(n) >= 2), sn AS (SELECT *,
 lag(s) OVER f AS l, lead(s) OVER f AS r FROM ssum WINDOW f AS (PARTITION BY vehicle_id, frame_index ORDER BY c)),
sa AS (SELECT sn.*, n FROM sn JOIN sb USING (vehicle_id) WHERE s < lo AND (l > hi OR r > hi)), sk AS (SELECT vehicle_id, c FROM sa
 GROUP BY 1, 2 HAVING count(*) > max(n) * 0.01),
samp AS (SELECT vehicle_id, frame_index, CAST(h IS NOT NULL AS INT) AS label FROM san LEFT JOIN (SELECT DISTINCT vehicle_id, frame_index, 1 AS h FROM sa SEMI
 JOIN sk USING (vehicle_id, c)) USING (vehicle_id, frame_index))"""
_SD = f"""{O.FRAMES}, {_san('voltages')}, {_CELL}, ce AS (SELECT *, x - median(x) OVER (PARTITION BY vehicle_id, c) AS y,
 count(*) OVER (PARTITION BY vehicle_id, c) AS n, row_number() OVER (PARTITION BY vehicle_id, c ORDER BY frame_index) - 1 AS i FROM cell),
cw AS (SELECT *, greatest(2, least({X.ROLLING}, n)) AS w FROM ce WHERE n >= 2), cf AS (SELECT *, avg(y) OVER (PARTITION BY vehicle_id, c
 ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND {X.ROLLING - 1} FOLLOWING) AS fw, avg(CASE WHEN i >= n - w THEN y END) OVER (PARTITION BY vehicle_id, c) AS tl FROM cw),
cu AS (SELECT vehicle_id, frame_index, c, y - CASE WHEN n > {X.ROLLING} AND i <= n - w THEN fw ELSE tl END AS u FROM cf),
 cb AS (SELECT vehicle_id, quantile_cont(u, 0.25) AS q1, quantile_cont(u, 0.75) AS q3 FROM cu GROUP BY 1),
co AS (SELECT * FROM (SELECT cu.*, q1, q3, min(u) OVER (PARTITION BY vehicle_id, frame_index) AS lo FROM cu JOIN cb USING (vehicle_id))
 WHERE u = lo AND (u < q1 - 3 * (q3 - q1) OR u > q3 + 3 * (q3 - q1))), cn AS (SELECT vehicle_id, c, count(*) AS k FROM co GROUP BY 1, 2),
ca AS (SELECT vehicle_id, c FROM (SELECT *, max(k) OVER (PARTITION BY vehicle_id) AS mk FROM cn) WHERE k > mk * 0.7), sdl AS (SELECT vehicle_id, frame_index,
 CAST(h IS NOT NULL AS INT) AS label FROM san LEFT JOIN (SELECT DISTINCT vehicle_id, frame_index, 1 AS h FROM co SEMI
 JOIN ca USING (vehicle_id, c)) USING (vehicle_id, frame_index))"""
_WIDTHS = [*S.PACK_CELLS]
_MODULES = ", ".join(f"({m}, {sum(_WIDTHS[:m])}, {w})" for m, w in enumerate(_WIDTHS))
_LONG_SD = _SD.replace(O.FRAMES, O.LONG_FRAMES + ", frames AS (SELECT * FROM fin)").replace(f"least({X.ROLLING}, n)", f"least({X.LONG['rolling']}, n)").replace(f"{X.ROLLING - 1} FOLLOWING", f"{X.LONG['rolling'] - 1} FOLLOWING").replace(f"n > {X.ROLLING} AND", f"n > {X.LONG['rolling']} AND")
_RAWL = " ".join(f"label_final_{f}:i" for f in _FAULTS)

_ICC = f"""wf AS (SELECT sample_id, unnest(voltages[1:15]) AS a, unnest(voltages[2:16]) AS b, unnest(range(15)) AS c
 FROM samples JOIN frames ON frames.vehicle_id = samples.vehicle_id AND frames.frame_index BETWEEN start_frame AND end_frame),
wm AS (SELECT sample_id, c, count(*) AS n, (sum(a) + sum(b)) / (2 * count(*)) AS m FROM wf GROUP BY 1, 2), wi AS (SELECT sample_id, c,
 CASE WHEN sum((a - m) * (a - m)) + sum((b - m) * (b - m)) = 0 THEN 1 ELSE 2 * sum((a - m) * (b - m)) / (sum((a - m) * (a - m)) + sum((b - m) * (b - m))) END AS icc
 FROM wf JOIN wm USING (sample_id, c) GROUP BY 1, 2), ic AS (SELECT sample_id, min(icc) AS conn_icc_min FROM wi GROUP BY 1)"""
_F32 = lambda x: f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
_CHANNELS = ["charge_status", "soc", "speed", "sum_voltage", "sum_current", "insulation_resistance", "v_range", "t_range"]
_ONCE = lambda sql: reduce(lambda q, c: q.replace(f"{c} AS (SELECT", f"{c} AS MATERIALIZED (SELECT"), ("frames", "samples", "sc", "fin", "feat", "ev", "f0"), sql)
_PACK_SQL = _ONCE(f"""{FEATURES}, {_ICC}, fi AS (SELECT * FROM feat JOIN ic USING (sample_id))|||
SELECT sample_id, 'x_seq' AS part, sc.frame_index - start_frame AS i, unnest(range(8)) AS j, unnest([{', '.join(_F32(c) for c in _CHANNELS)}]) AS value FROM samples JOIN sc ON sc.vehicle_id = samples.vehicle_id AND sc.frame_index BETWEEN start_frame AND end_frame
UNION ALL SELECT sample_id, 'x_feat', unnest(range({len(features.PACK_FEATURES)})), 0, unnest([{', '.join(_F32(c) for c in features.PACK_FEATURES)}]) FROM fi
""" + "".join(f"UNION ALL SELECT sample_id, 'y_{k}', unnest(range(5)), 0, unnest([{', '.join(f'CAST(y_{k}_{f} AS DOUBLE)' for f in _FAULTS)}]) FROM samples " for k in ("id", "warn")))

QUERIES = [
    Query(
        "insulation_events",
        insulation_events,
        "vehicle_id:s events:i frames:i longest_seconds:i",
        _events_sql(f"SELECT vehicle_id, frame_index, 'ins' AS fault_type, {O.merged('label')} AS label FROM ins", _INS) + "|||SELECT vehicle_id, count(*) AS events, sum(duration_frames) AS frames, max(duration_seconds) AS longest_seconds FROM evt GROUP BY 1",
    ),
    Query(
        "src1_manifest",
        _manifest,
        "vehicle_id:s source_dataset:s is_extracted:b entry_kind:s",
        "SELECT DISTINCT 'V' || user_id AS vehicle_id, 'raw_dataset' AS source_dataset, true AS is_extracted, 'directory' AS entry_kind FROM events",
    ),
    Query(
        "src2_structured",
        _csv_round_trip,
        f"{_KEY} charge_status:i cells:i v10:d v_last:d probes:i t_max:d soc:d speed:d",
        f"""{O.FRAMES}, fk AS (SELECT *, CAST(vehicle_id[2:] AS BIGINT) % 4 AS k FROM frames)
|||SELECT vehicle_id, frame_index, charge_status, CASE WHEN k = 2 THEN 12 ELSE 16 END AS cells, voltages[10] AS v10, voltages[CASE WHEN k = 2 THEN 12 ELSE 16 END] AS v_last,
 CASE WHEN k = 3 THEN 4 ELSE 8 END AS probes, list_max(temperatures[1 : CASE WHEN k = 3 THEN 4 ELSE 8 END]) AS t_max, CASE WHEN k = 3 THEN 0 ELSE soc END AS soc, CASE WHEN k IN (2, 3) THEN 0 ELSE speed END AS speed FROM fk""",
    ),
    Query("src3_raw", _raw_round_trip, f"{_KEY} items:i v_max:d probes:i r:d soc:d given:b", f"""{_RAWV}, rk AS (SELECT rv.*, CAST(vehicle_id[2:] AS BIGINT) % 3 AS k, CASE WHEN event_id % 13 <> 0 THEN (SELECT CAST(5 AS DOUBLE) * value FROM events e WHERE e.event_id = rv.event_id) END AS ir FROM rv)
|||SELECT vehicle_id, frame_index, CASE WHEN t IS NULL OR t = '' THEN 1 ELSE len(a) END AS items, CASE WHEN t IS NULL OR t = '' THEN 0 ELSE list_max(a) END AS v_max, 8 AS probes,
 CASE WHEN k = 2 THEN 0 ELSE coalesce(ir, 0) END AS r, CASE WHEN k = 0 THEN 0 ELSE event_id % 101 END AS soc, k <> 2 AND ir IS NOT NULL AS given FROM rk"""),
    Query(
        "src4_missing_columns",
        _missing_columns,
        "rows:i form:s message:s",
        "SELECT count(*) AS rows, unnest(['raw', 'structured']) AS form, unnest(['missing columns: batteryvoltage, probetemperatures', 'missing columns: TIME, CHARGE_STATUS']) AS message FROM events",
    ),
    Query(
        "snk2_by_ending",
        _by_ending,
        "ending:s event_id:i event_type:s value:d",
        "SELECT e.ending, event_id, event_type, value FROM events, (SELECT unnest(['csv', 'tsv', 'json', 'parquet']) AS ending) e",
    ),
    Query(
        "cln1_parse_sensor",
        lambda s, d: _raw(s, d).select("vehicle_id", "frame_index", F.size("voltages").alias("items"), S.array_sum(F.col("voltages")).alias("total")),
        f"{_KEY} items:i total:d",
        f"{_RAWV}|||SELECT vehicle_id, frame_index, len(a) AS items, coalesce(list_sum(a), 0) AS total FROM rv",
    ),
    Query(
        "cln2_normalize",
        lambda s, d: _normalized(s, d).select("vehicle_id", "frame_index", F.size("voltages").alias("items"), S.array_sum(F.col("voltages")).alias("total"), "ok"),
        f"{_KEY} items:i total:d ok:b",
        f"{_NORM}|||SELECT vehicle_id, frame_index, len(v) AS items, list_sum(v) AS total, ok FROM norm",
    ),
    Query(
        "cln3_quality",
        lambda s, d: _normalized(s, d).select("vehicle_id", "frame_index", clean.quality_flag(F.col("ok")).alias("quality_flag")),
        f"{_KEY} quality_flag:s",
        f"{_NORM}|||SELECT vehicle_id, frame_index, CASE WHEN ok THEN 'ok' ELSE 'low' END AS quality_flag FROM norm",
    ),
    Query(
        "cln4_epoch",
        lambda s, d: clean.epoch_seconds(X.raw_frames(s, d), "terminaltime"),
        f"{_KEY} timestamp:i",
        f"""{O.FRAMES}, t0 AS (SELECT vehicle_id, frame_index, CASE WHEN event_id % 7 <> 0 THEN timestamp END AS t, row_number() OVER ({_W}) AS i FROM frames),
t1 AS (SELECT *, max(CASE WHEN t IS NOT NULL THEN i END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bi, min(CASE WHEN t IS NOT NULL THEN i END) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ai FROM t0)
|||SELECT t1.vehicle_id, t1.frame_index, CASE WHEN t1.t IS NOT NULL THEN t1.t WHEN bi IS NULL THEN a.t WHEN ai IS NULL THEN b.t ELSE round_even(b.t + (a.t - b.t) * (CAST(t1.i - bi AS DOUBLE) / (ai - bi)), 0) END AS timestamp FROM t1 LEFT JOIN t0 b ON b.vehicle_id = t1.vehicle_id AND b.i = bi LEFT JOIN t0 a ON a.vehicle_id = t1.vehicle_id AND a.i = ai""",
    ),
    Query(
        "cln5_sanitize",
        _frames_san,
        f"{_KEY} v4:d v_sum:d",
        f"{O.FRAMES}, {_ZEROED}, {_san('voltages', 'zf')}|||SELECT vehicle_id, frame_index, v[4] AS v4, list_sum(v) AS v_sum FROM san",
    ),
    Query(
        "cln6_frame_scalars",
        lambda s, d: features.frame_scalars(X.frames(s, d)),
        f"{_KEY} v_range:d t_range:d median:d weak:d v_min:d t_max:d weak_cell:i v_sum:d gap:d",
        f"{_SCALARS}|||SELECT *, med AS median, v_min - med AS weak FROM sc",
    ),
    Query(
        "cln7_label_variant",
        lambda s, d: clean.select_labels(X.final_labels(s, d), _FAULTS, raw=True, ignore_quality=True),
        f"{_KEY} quality_flag:s {_RAWL}",
        f"{O.RAW_LABELS}|||SELECT vehicle_id, frame_index, 'ok' AS quality_flag, {', '.join(f'label_raw_{f} AS label_final_{f}' for f in _FAULTS)} FROM raw",
    ),
    Query(
        "cln8_only_vehicles",
        lambda s, d: clean.only_vehicles(X.raw_labels(s, d), "V1, V3,V7"),
        f"{_KEY} segment_id:i",
        f"{O.RAW_LABELS}|||SELECT * FROM raw WHERE vehicle_id IN ('V1', 'V3', 'V7')",
    ),
    Query("seg1_segments", X.raw_labels, f"{_KEY} segment_id:i is_continuous_segment:i", f"{O.EVENTS}, {O.SEGMENTS}|||SELECT * FROM seg"),
    Query("lbl1_self_discharge", lambda s, d: labels.self_discharge(X.frames(s, d), X.ROLLING), _LABEL, f"{_SD}|||SELECT * FROM sdl"),
    Query("lbl1_long_vehicles", lambda s, d: labels.self_discharge(X.long_frames(s, d), X.LONG["rolling"]), _LABEL, f"{_LONG_SD}|||SELECT * FROM sdl"),
    Query("lbl2_internal_short", lambda s, d: labels.internal_short(X.frames(s, d), X.CELLS, X.PROBES), _LABEL),
    Query(
        "lbl2a_modules",
        lambda s, d: labels.module_series(X.frames(s, d), X.CELLS, X.PROBES),
        f"{_KEY} module:i v:d t:d",
        f"""{O.FRAMES}|||SELECT vehicle_id, frame_index, m AS module, least(voltages[2 * m + 1], voltages[2 * m + 2]) AS v, temperatures[m + 1] AS t
 FROM frames, range(8) r(m)""",
    ),
    Query("lbl2a_pack_modules", lambda s, d: labels.module_series(X.pack_frames(s, d), *X.PACK), f"{_KEY} module:i v:d t:d", f"""{O.PACK_FRAMES}
|||SELECT vehicle_id, frame_index, m AS module, list_min(voltages[first + 1 : first + width]) AS v, greatest(temperatures[2 * m + 1], temperatures[2 * m + 2]) AS t FROM pack, (VALUES {_MODULES}) g(m, first, width)"""),
    Query("lbl2b_outlier_scores", lambda s, d: labels.module_scores(labels.module_series(X.frames(s, d), X.CELLS, X.PROBES)), f"{_KEY} module:i score:d"),
    Query("lbl3_connection", lambda s, d: labels.connection(X.frames(s, d)), _LABEL, f"{_CONN}|||SELECT * FROM conn"),
    Query(
        "lbl3a_icc",
        lambda s, d: labels.pair_icc(labels.steps(clean.sanitize(X.frames(s, d), "voltages"))),
        "vehicle_id:s cell:i icc:d",
        f"{_LBL3}|||SELECT * FROM pi",
    ),
    Query("lbl4_sampling", lambda s, d: labels.sampling(X.frames(s, d)), _LABEL, f"{_SAMP}|||SELECT * FROM samp"),
    Query("lbl5_insulation", lambda s, d: labels.insulation(X.frames(s, d)), _LABEL, f"{_INS}|||SELECT * FROM ins"),
    Query(
        "lbl6_core_labels",
        lambda s, d: labels.core_labels(X.frames(s, d), X.CELLS, X.PROBES, X.ROLLING),
        f"{_KEY} " + " ".join(f"label_raw_{f}:i" for f in _FAULTS) + " label_version:s label_source:s",
    ),
    Query("evt1_merge_gaps", X.final_labels, f"{_KEY} {_RAWL}", f"{O.FINAL_LABELS}|||SELECT * FROM fin"),
    Query("evt2_events", lambda s, d: events.extract_events(events.long_labels(X.final_labels(s, d))), _EVENT, f"{_EVT}|||SELECT * FROM evt"),
    Query(
        "evt3_first_events",
        lambda s, d: events.first_events(events.extract_events(events.long_labels(X.final_labels(s, d)))),
        _EVENT,
        f"{_EVT}|||SELECT * FROM evt WHERE event_id = 1",
    ),
    Query("win1_samples", X.samples, _SAMPLE, f"{O.SAMPLES}|||SELECT * FROM samples"),
    Query(
        "win1_long_vehicles",
        lambda s, d: windows.sample_windows(X.long_frames(s, d), X.LONG["window"], X.LONG["step"], X.LONG["horizon"]),
        _SAMPLE,
        f"{O.LONG_SAMPLES}|||SELECT * FROM samples",
    ),
    Query("win2_identification", X.samples, "sample_id:s " + " ".join(f"y_id_{f}:i" for f in _FAULTS), f"{O.SAMPLES}|||SELECT * FROM samples"),
    Query(
        "win3_warning",
        lambda s, d: X.samples(s, d).where("lead_time_sec is not null").groupBy("vehicle_id").agg(F.count("*").alias("warned"), F.avg("lead_time_sec").alias("lead")),
        "vehicle_id:s warned:i lead:d",
        f"{O.SAMPLES}|||SELECT vehicle_id, count(*) AS warned, avg(lead_time_sec) AS lead FROM samples WHERE lead_time_sec IS NOT NULL GROUP BY 1",
    ),
    Query(
        "win4_first_future",
        lambda s, d: X.samples(s, d).groupBy("future_first_fault", "lead_time_sec").agg(F.count("*").alias("n")),
        "future_first_fault:s lead_time_sec:i n:i",
        f"{O.SAMPLES}|||SELECT future_first_fault, lead_time_sec, count(*) AS n FROM samples GROUP BY 1, 2",
    ),
    Query(
        "win5_profile",
        lambda s, d: windows.window_profile(X.samples(s, d)),
        "vehicle_id:s window_count:i fault_vector:s " + " ".join(f"{t}_positive:i" for t in _TARGETS),
        f"{_PROFILE}|||SELECT * FROM prof",
    ),
    *(Query(f"fea{k}_{g}", lambda s, d, g=g: features.feature_groups(_features(s, d), g), _fcols(g), f"{FEATURES}|||SELECT * FROM feat") for k, g in ((1, "shared"), (2, "sd"), (4, "isc"), (5, "conn"), (7, "samp"), (8, "ins"))),
    Query(
        "fea6_icc",
        lambda s, d: _features(s, d, True),
        "sample_id:s conn_icc_min:d4",
        f"""{O.FRAMES}, {O.SAMPLES.replace(O.EVENTS + ', ', '')}, wf AS (SELECT sample_id, unnest(voltages[1:15]) AS a, unnest(voltages[2:16]) AS b, unnest(range(15)) AS c
 FROM samples JOIN frames ON frames.vehicle_id = samples.vehicle_id AND frames.frame_index BETWEEN start_frame AND end_frame),
wm AS (SELECT sample_id, c, count(*) AS n, (sum(a) + sum(b)) / (2 * count(*)) AS m FROM wf GROUP BY 1, 2), wi AS (SELECT sample_id, c,
 CASE WHEN sum((a - m) * (a - m)) + sum((b - m) * (b - m)) = 0 THEN 1 ELSE 2 * sum((a - m) * (b - m)) / (sum((a - m) * (a - m)) + sum((b - m) * (b - m))) END AS icc
 FROM wf JOIN wm USING (sample_id, c) GROUP BY 1, 2)|||SELECT sample_id, min(icc) AS conn_icc_min FROM wi GROUP BY 1""",
    ),
    Query(
        "fea9_sequences",
        lambda s, d: features.window_sequences(X.frames(s, d), X.samples(s, d), X.WINDOW).select("sample_id", F.size("x_seq").alias("steps"), F.element_at(F.element_at("x_seq", 1), 2).alias("first_soc"), F.aggregate("x_seq", F.lit(0.0), lambda a, r: a + F.get(r, F.lit(4)).cast("double")).alias("current")),
        "sample_id:s steps:i first_soc:d current:d",
        f"""{O.FRAMES}, {O.SAMPLES.replace(O.EVENTS + ', ', '')}
|||SELECT sample_id, count(*) AS steps, first(soc ORDER BY frame_index) AS first_soc, sum(sum_current) AS current FROM samples JOIN frames ON frames.vehicle_id = samples.vehicle_id AND frames.frame_index BETWEEN start_frame AND end_frame GROUP BY 1""",
    ),
    Query(
        "fea10_align",
        lambda s, d: features.align(_features(s, d), ["ins_rins_min", "not_there", "shared_soc"]),
        "sample_id:s ins_rins_min:d4 not_there:d shared_soc:d",
        f"{FEATURES}|||SELECT sample_id, ins_rins_min, 0 AS not_there, shared_soc FROM feat",
    ),
    Query(
        "fea11_normalise",
        lambda s, d: features.normalise(f := _features(s, d), features.train_statistics(f, _samples(s, d), ["shared_soc", "isc_module_tmax"]), ["shared_soc", "isc_module_tmax"]),
        "sample_id:s shared_soc:d4 isc_module_tmax:d4",
        f"""{FEATURES}, {O.SPLIT_MAP}, ts AS (SELECT avg(shared_soc) AS m1, stddev_pop(shared_soc) AS s1,
 avg(isc_module_tmax) AS m2, stddev_pop(isc_module_tmax) AS s2 FROM feat JOIN samples USING (sample_id) JOIN split_map USING (vehicle_id) WHERE split = 'train')
|||SELECT sample_id, (shared_soc - m1) / s1 AS shared_soc, (isc_module_tmax - m2) / s2 AS isc_module_tmax FROM feat, ts""",
    ),
    Query(
        "fea12_weights",
        lambda s, d: features.positive_weights(X.samples(s, d), _TARGETS),
        "target:s weight:d",
        f"{O.SAMPLES}|||" + " UNION ALL ".join(f"""SELECT '{t}' AS target, CASE WHEN sum({t}) = 0 OR sum({t}) = count(*) THEN 1 ELSE least(100, greatest(1,
 CAST(count(*) - sum({t}) AS DOUBLE) / sum({t}))) END AS weight FROM samples""" for t in _TARGETS),
    ),
    Query(
        "jn1_features_labels",
        lambda s, d: windows.features_with_labels(X.frames(s, d).select("vehicle_id", "frame_index", "soc"), X.raw_labels(s, d).select("vehicle_id", "frame_index", "label_raw_sd")),
        f"{_KEY} soc:d label_raw_sd:i",
        f"{O.RAW_LABELS}|||SELECT vehicle_id, frame_index, event_id % 101 AS soc, label_raw_sd FROM raw",
    ),
    Query(
        "jn2_window_frames",
        lambda s, d: windows.frames_of_samples(X.samples(s, d), X.frames(s, d).select("vehicle_id", "frame_index", "soc")).groupBy("sample_id").agg(F.count("*").alias("rows"), F.sum("soc").alias("soc")),
        "sample_id:s rows:i soc:d",
        f"""{O.FRAMES}, {O.SAMPLES.replace(O.EVENTS + ', ', '')}|||SELECT sample_id, count(*) AS rows, sum(soc) AS soc FROM samples
 JOIN frames ON frames.vehicle_id = samples.vehicle_id AND frames.frame_index BETWEEN start_frame AND end_frame GROUP BY 1""",
    ),
    Query(
        "jn3_samples_features",
        lambda s, d: X.samples(s, d).join(_features(s, d), "sample_id").groupBy("vehicle_id").agg(F.avg("shared_soc").alias("soc"), F.count("*").alias("n")),
        "vehicle_id:s soc:d n:i",
        f"{FEATURES}|||SELECT vehicle_id, avg(shared_soc) AS soc, count(*) AS n FROM samples JOIN feat USING (sample_id) GROUP BY 1",
    ),
    Query("jn5_split_lookup", _samples, "sample_id:s split:s", f"{O.SPLIT_SAMPLES}|||SELECT * FROM ss"),
    Query(
        "jn6_completeness",
        _completeness,
        "issue:s sample_id:s",
        f"""{O.SAMPLES}|||SELECT 'duplicate_tensor' AS issue, sample_id FROM samples WHERE end_frame % 7 = 1 UNION ALL SELECT 'missing_tensor', sample_id
 FROM samples WHERE end_frame % 7 = 0""",
    ),
    Query(
        "spl1_assign_splits",
        _splits,
        "vehicle_id:s split:s",
        f"""{_regrouped_sql(20)}, {_SEARCH}
|||SELECT id AS vehicle_id, CASE WHEN list_contains(t_ids, id) THEN 'test' WHEN list_contains(v_ids, id) THEN 'val' ELSE 'train' END AS split FROM ve, one""",
    ),
    Query(
        "spl1c_cover_splits",
        _covers,
        "test_id:b val_id:b train_id:b test_warn:b val_warn:b isc_eval:b isc_train:b conn_eval:b train_faults:i n_test:i n_val:i n_train:i",
        f"""RECURSIVE {_regrouped_sql(100)}, {_COVERS}|||SELECT ti = 7 AS test_id, vi = 7 AS val_id, ri = 7 AS train_id, tw = 7 AS test_warn, vw = 7 AS val_warn, ei > 0 AS isc_eval, rr > 0 AS isc_train, ec > 0 AS conn_eval,
 bit_count(CAST(ri AS INT)) AS train_faults, 20 AS n_test, 20 AS n_val, n - 40 AS n_train FROM one""",
    ),
    Query(
        "spl1b_greedy_splits",
        _greedy,
        "vehicle_id:s split:s",
        f"""{_PROFILE}, {_VEHICLES}, gr AS (SELECT id, row_number() OVER (ORDER BY bit_count(CAST(id_mask AS INT)) DESC, bit_count(CAST(warn_mask AS INT)) DESC, id_total DESC, windows DESC, id) - 1 AS r
 FROM ve)
|||SELECT id AS vehicle_id, CASE WHEN r % 3 = 0 AND r // 3 < 20 THEN 'test' WHEN r % 3 = 1 AND r // 3 < 20 THEN 'val' ELSE 'train' END AS split FROM gr""",
    ),
    Query(
        "spl2_random_splits",
        lambda s, d: splits.random_splits(X.split_map(s, d), 20, 20),
        "vehicle_id:s split:s",
        f"""{O.SPLIT_MAP}, rn AS (SELECT vehicle_id, row_number() OVER (ORDER BY {_DRAW('vehicle_id')}, vehicle_id) AS r FROM split_map)
|||SELECT vehicle_id, CASE WHEN r <= 20 THEN 'test' WHEN r <= 40 THEN 'val' ELSE 'train' END AS split FROM rn""",
    ),
    Query(
        "spl3_downsample",
        _downsampled,
        "sample_id:s vehicle_id:s split:s",
        f"""{O.SPLIT_SAMPLES}, own AS (SELECT *, {_POS} AS p FROM ss WHERE split = 'train'), tk AS (SELECT least(greatest(400 - count(*) FILTER (p), 0),
 count(*) FILTER (NOT p)) AS t, count(*) FILTER (NOT p) AS total FROM own),
sz AS (SELECT vehicle_id, count(*) FILTER (NOT p) AS size, count(*) FILTER (p) AS pos FROM own GROUP BY 1),
 sh AS (SELECT *, t * size / CAST(total AS DOUBLE) AS share, floor(t * size / CAST(total AS DOUBLE)) AS base FROM sz, tk),
ra AS (SELECT *, t - sum(base) OVER () AS leftover, row_number() OVER (ORDER BY share - base DESC, vehicle_id DESC) AS o FROM sh WHERE size > 0),
 dr AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY {_DRAW('sample_id')}, sample_id) AS r FROM own WHERE NOT p)
|||SELECT sample_id, vehicle_id, split FROM own WHERE p UNION ALL SELECT sample_id, dr.vehicle_id, split FROM dr JOIN ra USING (vehicle_id)
 WHERE r <= base + CASE WHEN o <= leftover THEN 1 ELSE 0 END""",
    ),
    Query(
        "spl4_cap",
        lambda s, d: splits.cap(_samples(s, d), 50),
        "sample_id:s split:s",
        f"""{O.SPLIT_SAMPLES}|||SELECT sample_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {_DRAW('sample_id')}, sample_id) AS r
 FROM ss) WHERE r <= 50""",
    ),
    Query(
        "spl5_bundle",
        lambda s, d: splits.medium_bundle((x := _samples(s, d)).where("split = 'train'"), x.where(splits.positive()), x.where("split = 'test'")),
        "sample_id:s split:s",
        f"{O.SPLIT_SAMPLES}|||SELECT * FROM ss WHERE split IN ('train', 'test') OR {_POS}",
    ),
    Query(
        "spl6_coverage",
        lambda s, d: splits.coverage_issues(splits.split_summary(_with_issues(s, d))),
        "level:s code:s",
        f"""{O.SPLIT_SAMPLES}, si AS (SELECT * REPLACE (CASE WHEN split = 'val' THEN 0 ELSE y_warn_sd END AS y_warn_sd,
 CASE WHEN split = 'val' THEN 0 ELSE y_id_samp END AS y_id_samp, CASE WHEN split = 'test' THEN 0 ELSE y_id_isc END AS y_id_isc,
 CASE WHEN split = 'test' THEN 0 ELSE y_warn_conn END AS y_warn_conn) FROM ss), su AS (SELECT split, {_SUMS} FROM si GROUP BY 1)|||""" + " UNION ALL ".join(f"SELECT '{'note' if f in ('isc', 'conn') else 'blocking'}' AS level, split || ':y_{k}_{f}' AS code FROM su WHERE y_{k}_{f} <= 0" for k in ("id", "warn") for f in _FAULTS),
    ),
    Query(
        "spl7_consistency",
        _consistency,
        "issue:s vehicle_id:s detail:s",
        f"""{O.SPLIT_SAMPLES}, mi AS (SELECT DISTINCT vehicle_id, split FROM ss), mp AS (SELECT vehicle_id,
 CASE WHEN CAST(vehicle_id[2:] AS BIGINT) % 11 = 0 THEN 'other' ELSE split END AS mapped FROM split_map WHERE CAST(vehicle_id[2:] AS BIGINT) % 10 <> 0)
|||SELECT * FROM (SELECT CASE WHEN split IS NULL THEN 'missing_in_samples' WHEN mapped IS NULL THEN 'missing_in_mapping' WHEN split <> mapped THEN 'split_mismatch' END AS issue, vehicle_id, coalesce(split, mapped) AS detail
 FROM mi FULL JOIN mp USING (vehicle_id)) WHERE issue IS NOT NULL""",
    ),
    Query(
        "spl8_external",
        lambda s, d: splits.external_pool(X.samples(s, d), X.raw_labels(s, d).where("source_dataset = 'raw_dataset'")),
        "sample_id:s split:s",
        f"""{O.SAMPLES}|||SELECT sample_id, 'external_test' AS split FROM samples WHERE vehicle_id IN (SELECT vehicle_id FROM raw
 WHERE source_dataset = 'raw_dataset')""",
    ),
    Query(
        "agg1_label_summary",
        lambda s, d: profiles.label_summary(X.final_labels(s, d)),
        "vehicle_id:s rows:i " + " ".join(f"positive_{f}:i" for f in _FAULTS),
        f"{O.FINAL_LABELS}|||SELECT vehicle_id, count(*) AS rows, {', '.join(f'sum(label_final_{f}) AS positive_{f}' for f in _FAULTS)} FROM fin GROUP BY 1",
    ),
    Query(
        "agg2_label_statistics",
        lambda s, d: profiles.label_statistics(X.final_labels(s, d)),
        "scope:s vehicles:i rows:i " + " ".join(f"positive_{f}:i" for f in _FAULTS),
        f"{O.FINAL_LABELS}|||SELECT coalesce(source_dataset, 'final') AS scope, count(DISTINCT vehicle_id) AS vehicles, count(*) AS rows, {', '.join(f'sum(label_final_{f}) AS positive_{f}' for f in _FAULTS)} FROM fin GROUP BY ROLLUP (source_dataset)",
    ),
    Query(
        "agg3_vehicle_profile",
        lambda s, d: profiles.vehicle_profile(X.raw_labels(s, d), X.WINDOW, X.STEP, ["label_raw_sd"]),
        "vehicle_id:s rows:i segments:i approx_windows:i charge_states:s source_label_raw_sd:i",
        f"""{O.RAW_LABELS}|||SELECT vehicle_id, count(*) AS rows,
 max(segment_id) AS segments, greatest(floor((count(*) - 6) / CAST(3 AS DOUBLE)) + 1, 0) AS approx_windows, array_to_string(list_sort(list(DISTINCT charge_status)), '|') AS charge_states,
 sum(label_raw_sd) AS source_label_raw_sd FROM raw GROUP BY 1""",
    ),
    Query(
        "agg4_project_profile",
        lambda s, d: profiles.project_profile(profiles.vehicle_profile(l := X.final_labels(s, d), X.WINDOW, X.STEP), windows.window_profile(X.samples(s, d)), profiles.label_summary(l), X.raw_labels(s, d).select("vehicle_id", "source_dataset", F.lit("csv").alias("entry_kind")).distinct()),
        "vehicle_id:s rows:i segments:i window_count:i positive_ins:i source_dataset:s entry_kind:s",
        f"""{_PROFILE}|||SELECT vehicle_id, rows, segments, coalesce(window_count, 0) AS window_count, positive_ins, source_dataset, 'csv' AS entry_kind
 FROM (SELECT vehicle_id, count(*) AS rows, max(segment_id) AS segments, sum(label_final_ins) AS positive_ins, any_value(source_dataset) AS source_dataset
 FROM fin GROUP BY 1) LEFT JOIN prof USING (vehicle_id)""",
    ),
    Query(
        "agg5_split_summary",
        lambda s, d: splits.split_summary(_samples(s, d)),
        "split:s sample_count:i " + " ".join(f"{t}:i" for t in _TARGETS),
        f"{O.SPLIT_SAMPLES}|||SELECT split, count(*) AS sample_count, {_SUMS} FROM ss GROUP BY 1",
    ),
    Query(
        "agg5b_split_vehicles",
        lambda s, d: splits.split_vehicle_counts(_samples(s, d)),
        "split:s vehicle_id:s sample_count:i",
        f"{O.SPLIT_SAMPLES}|||SELECT split, vehicle_id, count(*) AS sample_count FROM ss GROUP BY 1, 2",
    ),
    Query(
        "agg6_fault_coverage",
        lambda s, d: profiles.fault_coverage(windows.window_profile(X.samples(s, d))),
        "fault_type:s vehicles:i limited:b",
        f"{_PROFILE}|||" + " UNION ALL ".join(f"""SELECT '{f}' AS fault_type, count(*) FILTER (y_id_{f}_positive > 0) AS vehicles, count(*) FILTER (y_id_{f}_positive > 0) < 2 AS limited
 FROM prof""" for f in _FAULTS),
    ),
    Query(
        "agg7_label_distribution",
        lambda s, d: profiles.label_distribution(_samples(s, d)),
        "split:s target:s positives:i",
        f"{O.SPLIT_SAMPLES}|||" + " UNION ALL ".join(f"SELECT split, '{t}' AS target, sum({t}) AS positives FROM ss GROUP BY 1" for t in _TARGETS),
    ),
    Query(
        "snk1_bucketed",
        _bucketed,
        f"{_KEY} soc:d label_raw_sd:i change:d",
        f"{O.RAW_LABELS}|||SELECT vehicle_id, frame_index, event_id % 101 AS soc, label_raw_sd, event_id % 101 - lag(event_id % 101) OVER ({_W}) AS change FROM raw",
    ),
    Query("snk1_dataset_pack", _pack, "sample_id:s part:s i:i j:i value:d3", _PACK_SQL),
    Query("str1_segments", _stream_segments, "vehicle_id:s rows:i start_seconds:i end_seconds:i", f"{_SEGMENT_ROWS}|||SELECT * FROM sg"),
    Query("str2_events", _stream_events, "vehicle_id:s fault_type:s start_frame:i end_frame:i duration_frames:i", f"{_EVT}|||SELECT * FROM evt"),
]
