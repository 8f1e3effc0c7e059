"""A membership filter of fixed size, built by Spark and sent to all tasks.

It says "maybe" or "surely not" of a 64-bit value.  It only saves work: rows that pass are
joined exactly afterwards, and a filter that a large input has filled lets every row pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import mix

BITS = 1 << 26
_PART = 1 << 15


def _bit(values: np.ndarray) -> np.ndarray:
    return (mix(values.astype(np.int64).view(np.uint64) ^ np.uint64(0x9E6C63D0876A9A47)) % np.uint64(BITS)).astype(np.int64)


def build(df: DataFrame, column: str) -> Broadcast:
    """The filter of the values of a long column, as a broadcast bit array."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit(batch.column(0).drop_null().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(at // _PART), pa.array(at % _PART)], ["part", "bit"])

    parts = df.select(F.col(column).cast("long")).mapInArrow(bits, "part long, bit long").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    whole = np.zeros((BITS // _PART, _PART // 8), np.uint8)
    for r in parts.collect():
        whole[r.part] = np.frombuffer(bytes(r.bits), np.uint8)
    return df.sparkSession.sparkContext.broadcast(whole.ravel())


def maybe(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True where a value may be in the filter."""
    at = _bit(values)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
