"""The folder that driver and executors share, for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the checkpoint folder that the session has set.

    A session in one process (local tests) gets a temporary folder where neither is set; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fleetlens-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Intermediate Parquet tables of one operator run.

    ``keep`` writes a DataFrame once and reads it back, so that a lost executor costs a
    re-read and never a re-run of what came before; ``drop`` removes tables that no
    later step reads.  What a result still reads goes when the session's file system closes.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = fresh_path(spark, "tables")
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.tables)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        folder, files = self._at(path)
        files.deleteOnExit(folder)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            folder, files = self._at(next(p for t, p in self.tables if t is table))
            files.delete(folder, True)

    def drop_but(self, *tables: DataFrame) -> None:
        """Removes all tables but these."""
        for _, path in [x for x in self.tables if not any(x[0] is t for t in tables)]:
            folder, files = self._at(path)
            files.delete(folder, True)

    def _at(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
