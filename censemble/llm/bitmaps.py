"""Filters of fixed size, and small results in few files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A bitmap has this many address bits, whatever it is made of: 8 MB.
BITS = 26
_BLOCK_BITS = 16


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """One bit for every value of a 64-bit hash that occurs: always 2**BITS bits.

    It is put together from packed blocks, at most 2**BITS / 8 bytes in all. A value that does not
    occur may share a bit with one that does, the more the fuller the bitmap.
    """
    cell = F.shiftrightunsigned(F.col(column), 64 - BITS)
    cells = hashes.select(
        F.shiftright(cell, _BLOCK_BITS).cast("int").alias("block"), (cell % (1 << _BLOCK_BITS)).cast("int").alias("bit")
    ).distinct()

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _BLOCK_BITS, dtype=bool)
        bits[table.column("bit").to_numpy()] = True
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for row in cells.groupBy("block").applyInArrow(pack, "block int, bits binary").collect():
        begin = row["block"] << (_BLOCK_BITS - 3)
        out[begin : begin + (1 << (_BLOCK_BITS - 3))] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) may occur in the bitmap."""
    cells = hashes >> np.uint64(64 - BITS)
    return (bits[cells >> np.uint64(3)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8))) & 1 > 0


def few_files(df: DataFrame) -> DataFrame:
    """The rows in at most four partitions per core: for results far smaller than what they come from."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
