"""Named queries with their result columns and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPARK = {"i": "bigint", "s": "string", "d": "double", "b": "boolean"}
_SQL = {"i": "BIGINT", "s": "VARCHAR", "d": "DOUBLE", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    """``columns`` lists name:kind with kinds i, s, b and d (rounded to 6 digits) or d4 (to 4)."""

    name: str
    make: Callable[[SparkSession, str], DataFrame]
    columns: str
    sql: str | None = None

    def _columns(self) -> list[tuple[str, str, int]]:
        parts = [c.split(":") for c in self.columns.split()]
        return [(n, k[0], int(k[1:] or 6)) for n, k in parts]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.make(spark, sf_dir)
        cast = lambda n, k, r: F.round(F.col(n).cast("double"), r) + F.lit(0.0) if k == "d" else F.col(n).cast(_SPARK[k])
        return df.select(*(cast(*c).alias(c[0]) for c in self._columns()))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cast = lambda n, k, r: f'round(CAST("{n}" AS DOUBLE), {r}) + 0.0' if k == "d" else f'CAST("{n}" AS {_SQL[k]})'
        head, _, body = self.sql.rpartition("|||")
        return (f"WITH {head} " if head else "") + f"SELECT {', '.join(f'{cast(*c)} AS "{c[0]}"' for c in self._columns())} FROM ({body}) q"
