"""Trees of csv files whose headers differ, against a loop over the files."""

import csv
import math

import pytest

from fleetlens.operators import labels
from fleetlens.sources import telemetry

STRUCTURED = {
    "a": ("TIME,CHARGE_STATUS,SPEED,U_1,U_2,T_1", [(1, 3, 20, 3.5, 3.6, 30), (11, 3, "x", 3.5, "", 31)]),
    "b": ("T_1,SOC,U_2,U_10,U_1,U_3,CHARGE_STATUS,TIME", [(30, 50, 3.2, 3.9, 3.1, 3.3, 1, 1), (31, 51, 4.2, 4.9, 4.1, 4.3, 2, 11), (32, "", 5.2, 5.9, 5.1, 5.3, 3, 21)]),
    "c d [1]": ("﻿TIME,CHARGE_STATUS,U_1,T_2,T_1", [(5, 1, 3.3, 22, 21)]),
    "e": ("CHARGE_STATUS,TIME,SUM_VOLTAGE", [(4, 9, 77)]),
    "none": ("TIME,CHARGE_STATUS,U_1", []),
}
RAW = {
    "a": ("terminaltime,chargestatus,batteryvoltage,probetemperatures", [(1, 3, "3.6~3.7", "30"), (2, 3, "", "31~32")]),
    "b": ("speed,insulationresistance,probetemperatures,batteryvoltage,chargestatus,terminaltime,minvoltagebattery", [(55, 400, "31", "3.1~3.2", 1, 1, 3.1), (56, "", "32", "3.3~3.4", 2, 2, "")]),
}


def write(root, files):
    for name, (header, rows) in files.items():
        (root / f"{name}.csv").write_text("\n".join([header, *(",".join(map(str, r)) for r in rows)]) + "\n", encoding="utf-8")
    return str(root)


def number(text):
    try:
        x = float(text)
        return x if math.isfinite(x) else 0.0
    except (TypeError, ValueError):
        return 0.0


def loop(root):
    out = []
    for file in root.iterdir():
        with file.open(encoding="utf-8-sig") as f:
            for i, row in enumerate(csv.DictReader(f)):
                sensors = {p: [number(row[c]) for c in sorted((c for c in row if c.startswith(p)), key=lambda c: int(c[2:]))] for p in ("U_", "T_")}
                out.append((file.stem, i, int(number(row["CHARGE_STATUS"])), number(row.get("SPEED")), number(row.get("SOC")), number(row.get("SUM_VOLTAGE")), sensors["U_"], sensors["T_"]))
    return sorted(out)


def test_structured_files_are_read_by_their_own_headers(spark, tmp_path):
    df = telemetry.read_structured(spark, write(tmp_path, STRUCTURED))
    got = df.select("vehicle_id", "frame_index", "charge_status", "speed", "soc", "sum_voltage", "voltages", "temperatures").collect()
    assert sorted(map(tuple, got)) == loop(tmp_path)


def test_raw_files_are_read_by_their_own_headers(spark, tmp_path):
    df = telemetry.read_raw(spark, write(tmp_path, RAW))
    got = {(r.vehicle_id, r.frame_index): r for r in df.collect()}
    assert got["a", 0].voltages == [3.6, 3.7] and got["a", 1].temperatures == [31, 32] and got["a", 0].speed == 0
    assert got["b", 0].speed == 55 and got["b", 0].voltages == [3.1, 3.2] and got["b", 0].temperatures == [31] and got["b", 0].insulation_resistance == 400
    assert [(k, r.insulation_given) for k, r in sorted(got.items())] == [(("a", 0), False), (("a", 1), False), (("b", 0), True), (("b", 1), False)]
    assert got["b", 0].minvoltagebattery == 3.1 and got["a", 0].minvoltagebattery is None and got["b", 1].minvoltagebattery is None


def test_a_file_that_lacks_a_required_column_is_named(spark, tmp_path):
    write(tmp_path, {"good": STRUCTURED["a"], "bad": ("TIME,U_1", [(1, 2)])})
    with pytest.raises(ValueError, match=r"missing columns: CHARGE_STATUS \(in .*bad\.csv, 1 files\)"):
        telemetry.read_structured(spark, str(tmp_path))


def test_names_that_repeat_get_a_number():
    assert telemetry._column_names("﻿TIME,U_1,u_1,U_1, SOC") == ["TIME", "U_1", "u_1.1", "U_1.2", "SOC"]
