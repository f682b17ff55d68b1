"""A bit filter of fixed size over 64-bit hashes, to keep back rows that cannot match before they are shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24
_SLOTS = 32768


def bit_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """One bit for each of 2^24 leading parts of a hash, set where a row has it: two megabytes, whatever the table holds.

    It is built by a grouped aggregate of 512 buckets, each of 4096 bytes. With very many rows all bits are set: then nothing is
    kept back, and results stay the same.
    """
    slot = F.shiftrightunsigned(column, 64 - BITS)
    parts = hashes.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / _SLOTS).alias("bucket")).agg(F.expr(f"bitmap_construct_agg(slot % {_SLOTS})").alias("bits"))
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in parts.toLocalIterator():
        at = int(r["bucket"]) * _SLOTS // 8
        out[at : at + _SLOTS // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) may be in the filter."""
    slots = hashes >> np.uint64(64 - BITS)
    return (bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
