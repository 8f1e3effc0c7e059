"""The documents table, and columns whose names do not clash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import Scratch

__all__ = ["Scratch", "bounded", "documents", "fresh", "text_of", "with_fields"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that extra columns (whatever their names) never meet the operator's own."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where ``df`` has such a column already (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded(sample: DataFrame, key: str, size: str, rows: int, total: int) -> DataFrame:
    """The rows of ``sample`` whose keys, taken in order, fit into ``rows`` keys and ``total`` units of ``size``.

    ``sample`` has one row by key (a long), and is small already in expectation.  At most twice ``rows`` keys and sizes come to the driver.
    """
    left, chosen = total, []
    for r in sample.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).orderBy("key").limit(2 * rows).collect():
        if r.size <= left and len(chosen) < rows:
            left -= r.size
            chosen.append((r.key,))
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(chosen, f"`{key}` long")), key, "left_semi")


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and the fields of ``ddl`` after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
