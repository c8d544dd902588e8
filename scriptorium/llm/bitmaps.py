"""Bitmaps of hashes: filters whose size does not depend on the data.

A bit that another hash set lets a row pass that need not; no row is lost. Whoever
filters by a bitmap therefore decides afterwards, exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
LANES = "lane bigint, bits bigint"


def lanes(hashes: np.ndarray, bits: int = BITS) -> pa.RecordBatch:
    """(lane, bits): the 64-bit words of a bitmap that the hashes set."""
    at = np.unique(hashes & np.uint64(bits - 1))
    lane = (at >> np.uint64(6)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
    packed = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), heads)
    return pa.RecordBatch.from_arrays([pa.array(lane[heads]), pa.array(packed.view(np.int64))], names=["lane", "bits"])


def column_lanes(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """The lanes of a column of 64-bit hashes."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield lanes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)

    return df.select(column).mapInArrow(run, LANES)


def bitmap(found: DataFrame, bits: int = BITS) -> Broadcast:
    """The whole bitmap of lanes, as a broadcast of ``bits`` bits."""
    packed = found.groupBy("lane").agg(F.bit_or("bits").alias("bits")).toArrow()
    data = np.zeros(bits // 64, np.int64)
    data[packed.column(0).to_numpy()] = packed.column(1).to_numpy()
    return found.sparkSession.sparkContext.broadcast(data)


def marked(data: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = hashes & np.uint64(64 * len(data) - 1)
    return (data.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
