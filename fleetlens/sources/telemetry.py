"""Readers and writers of telemetry files."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.sensors import finite, parse_series

REQUIRED = {"structured": ("TIME", "CHARGE_STATUS"), "raw": ("terminaltime", "chargestatus", "batteryvoltage", "probetemperatures")}
_SCALARS = {"charge_status": "CHARGE_STATUS", "speed": "SPEED", "sum_voltage": "SUM_VOLTAGE", "sum_current": "SUM_CURRENT", "soc": "SOC", "insulation_resistance": "INSULATION_RESISTANCE"}
_RAW = {"charge_status": "chargestatus", "speed": "speed", "sum_voltage": "totalvoltage", "sum_current": "totalcurrent", "soc": "soc", "insulation_resistance": "insulationresistance"}
_LIMITS = ("minvoltagebattery", "maxvoltagebattery", "mintemperaturevalue", "maxtemperaturevalue")


def _load(spark: SparkSession, form: str, root) -> DataFrame:
    """All files of a tree.  Folders are listed in a few tasks a core; else each of up to 10,000 folders is a task of its own."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), 8 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.format(form).option("recursiveFileLookup", True).load(root)
    finally:
        spark.conf.set(name, before)


def scan_files(spark: SparkSession, structured_root: str | None, raw_root: str | None) -> DataFrame:
    """Manifest (vehicle_id, source_dataset, source_file, is_extracted, entry_kind) of two file trees.

    Structured: every csv.  Raw: the first csv of a directory (kind directory), csv files at the top (csv), and archives, which are not
    extracted (archive).  File contents are not read.  A directory without csv or archive is not seen.
    """

    def listing(root: str, dataset: str) -> DataFrame:
        files = _load(spark, "binaryFile", root).select(F.col("path").alias("source_file"))
        return files.select("source_file", F.lit(dataset).alias("source_dataset"), F.lower(F.regexp_extract("source_file", r"\.([^./]+)$", 1)).alias("ending"), F.regexp_extract("source_file", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.regexp_extract("source_file", r"([^/]+)/[^/]+$", 1).alias("parent"))

    parts = []
    if structured_root:
        s = listing(structured_root, "structured_dataset").where("ending = 'csv'")
        parts.append(s.select(F.col("stem").alias("vehicle_id"), "source_dataset", "source_file", F.lit(True).alias("is_extracted"), F.lit("csv").alias("entry_kind")))
    if raw_root:
        top = re.sub(r"/+$", "", raw_root).rsplit("/", 1)[-1]
        r = listing(raw_root, "raw_dataset")
        kind = F.when(F.col("ending") == "rar", "archive").when((F.col("ending") == "csv") & (F.col("parent") == top), "csv").when(F.col("ending") == "csv", "directory")
        r = r.withColumn("entry_kind", kind).where("entry_kind is not null")
        nested = F.col("entry_kind") == "directory"  # one group a directory, else one a file, so that the tree is gone through once
        r = r.groupBy("entry_kind", "source_dataset", F.when(nested, F.col("parent")).otherwise(F.col("stem")).alias("vehicle_id"), F.when(~nested, F.col("source_file")).alias("_file")).agg(F.min("source_file").alias("source_file"))
        parts.append(r.select("vehicle_id", "source_dataset", "source_file", (F.col("entry_kind") != "archive").alias("is_extracted"), "entry_kind"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_columns(df: DataFrame, columns) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def tree_lines(spark: SparkSession, path) -> DataFrame:
    """(value, file, begin, id): the lines with text of a tree of files; (begin, id) gives their order within a file, also where Spark splits it."""
    rows = _load(spark, "text", path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("id"))
    return rows.where(F.col("value").rlike(r"[^\x00-\x20]"))


def first_lines(lines: DataFrame) -> DataFrame:
    """(file, line): the first line with text of each file.  It reads lines of the files' first blocks and parses nothing."""
    return lines.where("begin = 0").groupBy("file").agg(F.min_by("value", "id").alias("line"))


def _column_names(line: str) -> list[str]:
    """The columns that a header line names; of names that differ in case only, or not at all, the later ones get a number."""
    out: list[str] = []
    for name in next(csv.reader([line.lstrip("\ufeff")])):
        taken = {c.lower() for c in out}
        k, free = 0, name.strip()
        while free.lower() in taken:
            k += 1
            free = f"{name.strip()}.{k}"
        out.append(free)
    return out


def _read_csv(spark: SparkSession, path, vehicle: str, required) -> tuple[DataFrame, list[list[str]]]:
    """Rows (vehicle_id, frame_index, _items, _at) of all files of a tree, and the headers that occur in it.

    _items has a row's fields as text, _at the place of each column by name, and as u and t those of the sensor columns in order, by the header of the row's own file.
    The vehicle is a file's stem, or its folder.  Only the distinct headers come to the driver; one that lacks a column of ``required`` is an error that names the columns and a file.
    """
    lines = tree_lines(spark, path)
    heads = first_lines(lines).groupBy("line").agg(F.min("file").alias("file"), F.count("*").alias("files")).orderBy("line").collect()
    if not heads:
        raise ValueError(f"no header in {path}")
    headers = [_column_names(h.line) for h in heads]
    for head, names in zip(heads, headers):
        if missing := [c for c in required if c not in names]:
            raise ValueError(f"missing columns: {', '.join(missing)} (in {unquote(head.file)}, {head.files} files)")
    wanted = [*_SCALARS.values(), *_RAW.values(), *_LIMITS, *(c for cs in REQUIRED.values() for c in cs)]
    wanted = [c for c in dict.fromkeys(wanted) if any(c in names for names in headers)]
    places = [(h.line, ([names.index(c) if c in names else None for c in wanted] + [[names.index(c) for c in _sensor_columns(names, p)] for p in "UT"])) for h, names in zip(heads, headers)]
    known = spark.createDataFrame(places, f"_line string, _at struct<{', '.join(f'`{c}`: int' for c in wanted)}, u: array<int>, t: array<int>>")

    ends = F.url_decode(F.replace(F.substring_index("file", "/", -2), F.lit("+"), F.lit("%2B")))  # a pattern over the whole path of every row takes longer than parsing the row
    name = {"stem": F.regexp_extract(F.substring_index(ends, "/", -1), r"^(.+)\.[^.]+$", 1), "folder": F.substring_index(ends, "/", 1)}[vehicle]
    rows = lines.withColumn("vehicle_id", name)
    w = Window.partitionBy("vehicle_id", "file").orderBy("begin", "id")
    rows = rows.withColumns({"_line": F.first("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(w)}).where("_n > 1")
    rows = _indexed(rows, ("file", "begin", "id")).join(F.broadcast(known), "_line")
    fields = [f"c{k}" for k in range(max(map(len, headers)))]
    rows = rows.select("vehicle_id", "frame_index", "_at", F.from_csv("value", ", ".join(f"{c} string" for c in fields)).alias("_csv"))
    return rows.select("vehicle_id", "frame_index", "_at", F.array(*(F.col(f"_csv.{c}") for c in fields)).alias("_items")), headers


def _sensor_columns(names: list[str], prefix: str) -> list[str]:
    found = [(int(m[1]), c) for c in names if (m := re.fullmatch(rf"{prefix}_(\d+)", c))]
    return [c for _, c in sorted(found)]


class _Wide:
    """The columns of a DataFrame of text."""

    def __init__(self, df: DataFrame):
        self.df, self.names = df, set(df.columns)

    def text(self, name: str) -> Column:
        return F.col(f"`{name}`") if name in self.names else F.lit(None).cast("string")

    def sensors(self, prefix: str) -> Column:
        return F.array(*(finite(self.text(c).try_cast("double")) for c in _sensor_columns(self.df.columns, prefix))).cast("array<double>")


class _Tree(_Wide):
    """The same of rows of ``_read_csv``, whose columns stand where the row's own header has them."""

    def __init__(self, rows: DataFrame, headers: list[list[str]]):
        self.df, self.names = rows, {c for names in headers for c in names}

    def text(self, name: str) -> Column:
        return F.get("_items", F.col(f"_at.`{name}`")) if name in self.names else F.lit(None).cast("string")

    def sensors(self, prefix: str) -> Column:
        return F.transform(F.transform(f"_at.{prefix.lower()}", lambda i: F.get("_items", i).try_cast("double")), finite)


def _indexed(df: DataFrame, order) -> DataFrame:
    return df.withColumn("frame_index", (F.row_number().over(Window.partitionBy("vehicle_id").orderBy(*order)) - 1).cast("int"))


def _scalars(at: _Wide, names: dict[str, str]) -> list[Column]:
    scalars = {k: finite(at.text(c).try_cast("double")).alias(k) for k, c in names.items()}
    scalars["charge_status"] = scalars["charge_status"].cast("int").alias("charge_status")
    return list(scalars.values())


def _structured(at: _Wide, keys) -> DataFrame:
    return at.df.select(*keys, at.text("TIME").alias("time"), *_scalars(at, _SCALARS), at.sensors("U").alias("voltages"), at.sensors("T").alias("temperatures"), F.lit(True).alias("insulation_given"))


def _raw(at: _Wide, keys) -> DataFrame:
    limits = [at.text(c).try_cast("double").alias(c) for c in _LIMITS if c in at.names]
    given = at.text("insulationresistance").try_cast("double")
    given = F.coalesce(given.isNotNull() & ~F.isnan(given), F.lit(False))
    return at.df.select(*keys, at.text("terminaltime").alias("time"), *_scalars(at, _RAW), parse_series(at.text("batteryvoltage")).alias("voltages"), parse_series(at.text("probetemperatures")).alias("temperatures"), given.alias("insulation_given"), *limits)


def _numbered(rows: DataFrame, order) -> DataFrame:
    rows = _indexed(rows, order)
    return rows.select("vehicle_id", "frame_index", *(c for c in rows.columns if c not in ("vehicle_id", "frame_index", *order)))


def standardize_structured(df: DataFrame, order=("_row",)) -> DataFrame:
    """Wide rows to frames: sensor columns by number of their suffix into arrays, scalars as numbers with 0 for what is none."""
    return _numbered(_structured(_Wide(require_columns(df, REQUIRED["structured"])), ("vehicle_id", *order)), order)


def standardize_raw(df: DataFrame, order=("_row",)) -> DataFrame:
    """Raw rows to frames: joined series into arrays, missing optional columns 0, minimum and maximum columns null where they are no number.

    insulation_given tells whether the row has an insulation resistance.
    """
    return _numbered(_raw(_Wide(require_columns(df, REQUIRED["raw"])), ("vehicle_id", *order)), order)


def read_structured(spark: SparkSession, path, vehicle: str = "stem") -> DataFrame:
    """Frames of wide csv files; ``vehicle`` says whether a file's stem or its folder names the vehicle.

    Files are read by their own headers: columns may come in any order, a file has as many cells and probes as its header names, and optional
    columns that it lacks are 0 there.
    """
    return _structured(_Tree(*_read_csv(spark, path, vehicle, REQUIRED["structured"])), ("vehicle_id", "frame_index"))


def read_raw(spark: SparkSession, path, vehicle: str = "stem") -> DataFrame:
    """Frames of raw csv files, each read by its own header; ``vehicle`` as in ``read_structured``."""
    return _raw(_Tree(*_read_csv(spark, path, vehicle, REQUIRED["raw"])), ("vehicle_id", "frame_index"))


def write_csv_tree(df: DataFrame, root: str, forms: dict[str, tuple[Column, list]], vehicle: str = "vehicle_id", sort=("frame_index",)) -> None:
    """Writes a csv with a header for each vehicle, in a folder ``vehicle``=... of its own under ``root``/form.

    ``forms`` gives a condition and the columns by form; a vehicle is of the first form whose condition its rows meet.  In a folder of the file system that all tasks
    share (a path, or file:) tasks write the files themselves, a line at a time: Hadoop's local file system starts a process for each folder, file and checksum
    file to set its mode.  A file gets its name when it is whole.  Elsewhere Spark's own writer makes the tree, form by form.
    """
    local = re.fullmatch(r"(?:file:(?://)?)?(/[^/].*)", root)
    if not local:
        for form, (condition, columns) in forms.items():
            part = df.where(condition).select(vehicle, *sort, *columns).repartition(vehicle).sortWithinPartitions(vehicle, *sort)
            part.drop(*sort).write.option("header", True).partitionBy(vehicle).csv(f"{root}/{form}")
        return
    headers = {form: df.select(*columns).columns for form, (_, columns) in forms.items()}
    form, line = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (condition, columns) in reversed(forms.items()):
        form, line = F.when(condition, F.lit(name)).otherwise(form), F.when(condition, F.to_csv(F.struct(*columns))).otherwise(line)
    rows = df.select(F.col(vehicle).cast("string").alias("_vehicle"), *sort, form.alias("_form"), line.alias("_line")).where("_form is not null")
    rows = rows.repartition("_vehicle").sortWithinPartitions("_vehicle", "_form", *sort).select("_vehicle", "_form", "_line")
    top, key = local[1], vehicle

    def write(batches):
        import csv
        import os
        import uuid
        from urllib.parse import quote

        place, out, ready = None, None, None
        for batch in batches:
            vehicles, names, lines = (c.to_pylist() for c in batch.columns)
            for k, here in enumerate(zip(vehicles, names)):
                if here != place:
                    if out:
                        out.close()
                        os.replace(*ready)
                    folder = f"{top}/{here[1]}/{key}={quote(here[0], safe=' ')}"
                    os.makedirs(folder, exist_ok=True)
                    place, ready = here, (f"{folder}/.{uuid.uuid4().hex}", f"{folder}/part-0.csv")
                    out = open(ready[0], "w", encoding="utf-8", newline="")
                    csv.writer(out, lineterminator="\n").writerow(headers[here[1]])
                out.write(lines[k])
                out.write("\n")
        if out:
            out.close()
            os.replace(*ready)
        yield from ()

    rows.mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()


def write_table(df: DataFrame, path: str, partition=(), sort=(), form: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes a table by partition columns, its files sorted; csv only for flat tables."""
    df = df.repartition(*partition, *[c for c in sort[:1] if c not in partition]) if partition or sort else df
    df = df.sortWithinPartitions(*partition, *sort) if sort else df
    writer = df.write.mode(mode).format(form)
    writer = writer.option("header", True) if form == "csv" else writer
    (writer.partitionBy(*partition) if partition else writer).save(path)


def bucket_count(rows: int, least: int = 8, most: int = 4096) -> int:
    """Buckets for tables of so many rows: ``least``, doubled until there are at most 125,000 rows in one, so that a task's sort does not grow with the table."""
    n = least
    while n < most and n * 125_000 < rows:
        n *= 2
    return n


def write_bucketed(df: DataFrame, name: str, buckets: int, by: str = "vehicle_id", sort=("frame_index",), path: str | None = None) -> DataFrame:
    """Writes ``df`` as the catalogue's table ``name`` in ``buckets`` of ``by``, a file a bucket, rows in order; and reads it.

    Windows and groups by the column need no exchange then, nor do joins on it of tables with as many buckets; joins on it and more columns need
    none where the session has spark.sql.requireAllClusterKeysForCoPartition at false (else Spark deals both sides anew).
    ``path`` names a folder for the table; else it goes to the warehouse.
    """
    writer = df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by, *sort).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def read_dataset(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A table by its file ending: csv, tsv, txt (tabs), json, parquet.

    Text files are UTF-8, or GBK where a line is not valid UTF-8; ``encoding`` names another.  For other than Unicode encodings the
    session is set to allow all of Java's (spark.sql.legacy.javaCharsets).
    """
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "parquet":
        return spark.read.parquet(path)
    if ending not in ("csv", "tsv", "txt", "json"):
        raise ValueError(f"no reader for .{ending}")
    if encoding is None:
        encoding = "UTF-8" if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty() else "GBK"
    if not encoding.upper().startswith("UTF"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    if ending == "json":
        return spark.read.option("encoding", encoding).option("lineSep", "\n").json(path)
    df = spark.read.option("header", True).option("inferSchema", True).option("encoding", encoding).option("sep", "," if ending == "csv" else "\t").csv(path)
    return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))
