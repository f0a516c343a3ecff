"""Bitmaps of hashes, of a bounded size whatever the number of hashes: a first sieve before a shuffle.

A row whose bit is not set is certainly not among the hashes; the others are left to the join that follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 15  # bits that one row holds on the way to the driver
MOST = 1 << 28  # 32 MB


def bitmap(hashes: DataFrame, most: int = MOST) -> tuple[np.ndarray, int]:
    """(bits, mask) of the column h: 64 bits a hash or more, up to `most`; the driver fetches each segment once."""
    n = hashes.select("h").distinct().count()
    size = min(most, max(1 << 22, 1 << (64 * n).bit_length()))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column("b").to_numpy()
            for segment in np.unique(bit // SEGMENT):
                held.setdefault(int(segment), np.zeros(SEGMENT, np.uint8))[bit[bit // SEGMENT == segment] % SEGMENT] = 1
        rows = [(s, np.packbits(bits, bitorder="little").tobytes()) for s, bits in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["s", "bits"])

    b = F.col("h").bitwiseAND(F.lit(size - 1))
    rows = hashes.select(b.alias("b")).distinct().repartition(F.floor(F.col("b") / SEGMENT)).mapInArrow(packed, "s long, bits binary").collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        out[r.s * SEGMENT // 8 : (r.s + 1) * SEGMENT // 8] = np.frombuffer(r.bits, np.uint8)
    return out, size - 1


def has_bit(h: np.ndarray, bits: np.ndarray, mask: int) -> np.ndarray:
    bit = (h.astype(np.uint64) & np.uint64(mask)).astype(np.int64)
    return ((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


def sieve(hashes: DataFrame, most: int = MOST):
    """A function of a column of hashes (long): whether it may be among those of the column h.  Only the hashes go to
    Python."""
    shipped = hashes.sparkSession.sparkContext.broadcast(bitmap(hashes, most))

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        return pd.Series(has_bit(h.to_numpy(np.int64), *shipped.value))

    return may
