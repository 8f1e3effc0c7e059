"""The derived tables of ``fixtures`` as SQL, and helpers to write expected results."""

from __future__ import annotations

from .fixtures import CELLS, HORIZON, LONG, MAX_GAP, MODELS, PACK, PROBES, STEP, WINDOW

FAULTS = ("sd", "isc", "conn", "samp", "ins")
_STATUS = "CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 4 ELSE 3 END"

EVENTS = "ev AS (SELECT *, 'V' || user_id AS vehicle_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp FROM events)"
FRAMES = f"""{EVENTS}, vec AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), cnt AS (SELECT count(*) AS n
 FROM embeddings),
f0 AS (SELECT ev.*, {_STATUS} AS charge_status, list_transform(range(1, {CELLS + 1}), lambda i: CAST(3.6 AS DOUBLE) + CAST(0.2 AS DOUBLE) * e[i] - CASE WHEN user_id % {CELLS} = i - 1 THEN CAST(0.004 AS DOUBLE) * greatest(value - 100, 0) ELSE 0 END) AS voltages,
 list_transform(range({CELLS + 1}, {CELLS + PROBES + 1}), lambda i: CAST(30 AS DOUBLE) + CAST(40 AS DOUBLE) * e[i] + CAST(0.3 AS DOUBLE) * value) AS temperatures
 FROM ev, cnt JOIN vec ON vec_id = event_id % n),
frames AS (SELECT vehicle_id, frame_index, timestamp, charge_status, CAST(event_id % 121 AS DOUBLE) AS speed, list_sum(voltages) AS sum_voltage,
 CAST(event_id % 61 - 30 AS DOUBLE) AS sum_current, CAST(event_id % 101 AS DOUBLE) AS soc,
 CAST(5 AS DOUBLE) * value AS insulation_resistance, voltages, temperatures, event_id, value, event_type, ts FROM f0)"""

_W = "PARTITION BY vehicle_id ORDER BY frame_index"
SEGMENTS = f"""seg AS (SELECT *, CAST(sum(opens) OVER ({_W}) AS BIGINT) AS segment_id, 1 - opens AS is_continuous_segment FROM
 (SELECT *, CASE WHEN lag(timestamp) OVER ({_W}) IS NULL OR timestamp - lag(timestamp) OVER ({_W}) > {MAX_GAP} THEN 1 ELSE 0 END AS opens FROM ev))"""
_RULES = {"sd": "value > 40", "isc": "event_type = 'error' AND value > 25", "conn": "event_id % 17 = 0", "samp": "event_id % 11 < 2", "ins": f"{_STATUS} IN (1, 2) AND value < 9"}
RAW_LABELS = f"""{EVENTS}, {SEGMENTS}, raw AS (SELECT vehicle_id, frame_index, timestamp, {_STATUS} AS charge_status, event_id, value, segment_id,
 CASE WHEN event_id % 29 = 0 THEN 'low' ELSE 'ok' END AS quality_flag,
 CASE WHEN user_id % 4 = 0 THEN 'raw_dataset' ELSE 'structured_dataset' END AS source_dataset, {', '.join(f'CAST({_RULES[f]} AS INT) AS label_raw_{f}' for f in FAULTS)} FROM seg)"""


def merged(column: str, gap: int = 2) -> str:
    at = f"CASE WHEN {column} = 1 THEN frame_index END"
    before, after = f"max({at}) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"min({at}) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"CAST(coalesce({column} = 1 OR {after} - {before} - 1 <= {gap}, false) AS INT)"


FINAL_LABELS = f"{RAW_LABELS}, fin AS (SELECT *, {', '.join(f'{merged(f'label_raw_{f}')} AS label_final_{f}' for f in FAULTS)} FROM raw)"


_TARGETS = [f"y_id_{f}" for f in FAULTS] + [f"y_warn_{f}" for f in FAULTS]


def windows(window: int, step: int, horizon: int) -> str:
    """Samples of the labelled frames ``fin``."""
    lead = lambda f: "CASE " + " ".join(f"WHEN lead(label_final_{f}, {k}) OVER w = 1 THEN {k}" for k in range(1, horizon + 1)) + " END"
    first = "list_sort(list_filter([" + ", ".join(f"CASE WHEN y_warn_{f} = 1 THEN {{'l': lead_{f}, 'o': {k}, 'f': '{f}'}} END" for k, f in enumerate(FAULTS)) + "], lambda x: x IS NOT NULL))[1]"
    recent = lambda f: f"CAST(sum(label_final_{f}) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS INT) AS y_id_{f}"
    return f"""win0 AS (SELECT *, lag(frame_index, {window - 1}) OVER w AS start_frame, lag(timestamp, {window - 1}) OVER w AS start_time,
 lag(segment_id, {window - 1}) OVER w AS seg0, count(*) OVER (PARTITION BY vehicle_id) AS n, {', '.join(f'{recent(f)}, {lead(f)} AS lead_{f}' for f in FAULTS)} FROM fin WINDOW w AS ({_W})),
win1 AS (SELECT *, {', '.join(f'CAST(coalesce(y_id_{f} = 0 AND lead_{f} > 0, false) AS INT) AS y_warn_{f}' for f in FAULTS)} FROM win0
 WHERE start_frame % {step} = 0 AND start_frame <= n - {window} - {horizon} AND seg0 = segment_id AND quality_flag <> 'low'),
samples AS (SELECT vehicle_id || '_' || lpad(CAST(row_number() OVER (PARTITION BY vehicle_id ORDER BY start_frame) - 1 AS VARCHAR), 6, '0') AS sample_id,
 vehicle_id, segment_id, start_time, timestamp AS end_time, start_frame, frame_index AS end_frame, quality_flag,
 {', '.join(_TARGETS)}, {first}['f'] AS future_first_fault, {first}['l'] * 10 AS lead_time_sec FROM win1)"""


SAMPLES = f"{FINAL_LABELS}, {windows(WINDOW, STEP, HORIZON)}"
_LONG_RULES = {"sd": "value > 60", "isc": "event_id % 31 = 0", "conn": "event_id % 17 < 3", "samp": "event_id % 11 < 2", "ins": "value < 2"}
LONG_FRAMES = f"""lf0 AS (SELECT *, 'L' || event_type AS vehicle_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame_index
 FROM events),
ev AS (SELECT *, frame_index * 10 + (frame_index // 400) * 60 AS timestamp, CASE WHEN event_id % 29 = 0 THEN 'low' ELSE 'ok' END AS quality_flag,
 list_transform(range(1, 7), lambda i: CAST(3.7 AS DOUBLE) + ((event_id * i) % 101) / CAST(5000 AS DOUBLE) - CASE WHEN i = 2 THEN value / CAST(1000 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS voltages,
 3 AS charge_status, {', '.join(f'CAST({_LONG_RULES[f]} AS INT) AS label_final_{f}' for f in FAULTS)} FROM lf0),
{SEGMENTS.replace(str(MAX_GAP), str(LONG['max_gap']))}, fin AS (SELECT * FROM seg)"""
LONG_SAMPLES = f"{LONG_FRAMES}, {windows(LONG['window'], LONG['step'], LONG['horizon'])}"
_ITEM = "CAST(embedding[({}) % len(embedding) + 1] AS DOUBLE)"
PACK_FRAMES = f"""{EVENTS}, cnt AS (SELECT count(*) AS n FROM embeddings), pack AS (SELECT vehicle_id, frame_index,
 list_transform(range({PACK[0]}), lambda i: CAST(3.6 AS DOUBLE) + CAST(0.2 AS DOUBLE) * {_ITEM.format('i')} + CAST(0.001 AS DOUBLE) * i) AS voltages,
 list_transform(range({PACK[1]}), lambda i: CAST(30 AS DOUBLE) + CAST(40 AS DOUBLE) * {_ITEM.format('i * 3')} + CAST(0.3 AS DOUBLE) * value) AS temperatures
 FROM ev, cnt JOIN embeddings ON vec_id = event_id % n)"""
SPLIT_MAP = "split_map AS (SELECT DISTINCT 'V' || user_id AS vehicle_id, CASE user_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM events)"
SPLIT_SAMPLES = f"""{SAMPLES}, {SPLIT_MAP}, ss AS (SELECT samples.*, coalesce(split, 'external_test') AS split FROM samples LEFT
 JOIN split_map USING (vehicle_id))"""

_D = lambda x: f"CAST({x} AS DOUBLE)"
PREDICTIONS = f"""{EVENTS}, p0 AS (SELECT vehicle_id, 'S' || event_id AS sample_id, event_id, user_id, least(value, 100) / {_D(100)} AS v, timestamp AS end_time, k, ['sd', 'isc', 'conn', 'samp', 'ins'][k + 1] AS fault_type
 FROM ev, range(5) r(k)),
p1 AS (SELECT *, {_D('(event_id * 7 + k * 13) % 97')} / {_D(97)} * {_D(0.6)} + v * {_D(0.4)} AS y_score, {_D('(event_id * 5 + k * 11) % 89')} / {_D(89)} AS noise
 FROM p0),
pred AS (SELECT vehicle_id, sample_id, event_id, user_id, end_time, fault_type, y_score, CAST(y_score * {_D(0.5)} + v * {_D(0.2)} + noise * {_D(0.3)} > {_D(0.38)} AS INT) AS y_true, {_D(0.5)} AS threshold, ['{MODELS[0]}', '{MODELS[1]}', '{MODELS[2]}'][event_id % 3 + 1] AS model_name,
 CASE WHEN event_id % 2 = 0 THEN 'warn' ELSE 'id' END AS task_type, CASE user_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
 CASE WHEN event_id % 5 <> 0 THEN (1 + event_id % 6) * 10 END AS lead_time_sec, CAST(y_score >= {_D(0.5)} AS INT) AS y_pred FROM p1)"""
