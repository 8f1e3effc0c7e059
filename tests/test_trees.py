"""Trees of files: written without a process a file, gone through once, read without lists of files in the driver."""

import csv

from pyspark.sql import functions as F

from fleetlens.sources import telemetry
from fleetlens.sources.shared import fresh_path


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_tree_has_a_csv_by_vehicle(spark):
    root = fresh_path(spark, "csv")
    data = [(v, i, f'{i},"x"' if i % 2 else None, "" if i % 3 else "é") for v in ("V1", "V2", "a b/c") for i in range(50)]
    df = spark.createDataFrame(data, "vehicle_id string, frame_index int, a string, b string").repartition(5)
    one = F.col("vehicle_id") == "V1"
    telemetry.write_csv_tree(df, root, {"x": (one, ["b", "a"]), "y": (~one, ["a", F.col("frame_index").alias("n")])})
    from pathlib import Path

    top = Path(root.removeprefix("file://"))
    files = sorted(str(f.relative_to(top)) for f in top.rglob("*") if f.is_file())
    assert files == ["x/vehicle_id=V1/part-0.csv", "y/vehicle_id=V2/part-0.csv", "y/vehicle_id=a b%2Fc/part-0.csv"]
    for file in files:
        with open(top / file, encoding="utf-8") as f:
            rows = list(csv.reader(f, escapechar="\\"))
        assert rows[0] == (["b", "a"] if file[0] == "x" else ["a", "n"]) and len(rows) == 51
        assert [r[1] for r in rows[1:]] == [str(i) for i in range(50)] if file[0] == "y" else [r[1] for r in rows[2::2]] == [f'{i},"x"' for i in range(1, 50, 2)]


def test_a_tree_is_one_scan(spark, tmp_path):
    for k, (head, row) in enumerate((("TIME,CHARGE_STATUS,U_1", "1,3,3.5"), ("U_1,TIME,CHARGE_STATUS", "3.25,1,2"), ("CHARGE_STATUS,TIME,U_2", "1,1,7"))):
        (tmp_path / f"v{k}").mkdir()
        (tmp_path / f"v{k}" / "a.csv").write_text(f"{head}\n{row}\n")
    df = telemetry.read_structured(spark, f"file://{tmp_path}", "folder")
    assert sorted((r.vehicle_id, r.charge_status, r.voltages) for r in df.collect()) == [("v0", 3, [3.5]), ("v1", 2, [3.25]), ("v2", 1, [7.0])]
    assert plan(df).count("Relation ") == 1
    assert plan(telemetry.scan_files(spark, None, f"file://{tmp_path}")).count("Relation ") == 1
