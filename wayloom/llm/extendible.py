"""The directory of extendible hashing: hash prefixes, a bucket being split on one more bit while it is too large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 60


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as a number that is never negative."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def prefix(hashed: Column, bits: int) -> Column:
    return F.shiftright(hashed, HASH_BITS - bits)


def directory(cells: DataFrame, above: int, bits: int, capacity: int) -> DataFrame:
    """The bucket of each cell: (cell, depth, bucket), where cells hold the first `bits` bits of a hash and their size.

    Depths run from `above` to `bits`. A cell belongs to the bucket of the smallest depth at which all cells that share its
    prefix fit `capacity` together: the directory doubles where a bucket is overfull, and nowhere else. Cells that are too
    large alone keep depth `bits` and the caller goes on from there.
    """
    at = cells.select("cell", "size", F.explode(F.sequence(F.lit(above), F.lit(bits))).alias("depth")).withColumn(
        "bucket", F.expr(f"shiftright(cell, {bits} - depth)")
    )
    fits = at.groupBy("depth", "bucket").agg(F.sum("size").alias("held")).filter((F.col("held") <= capacity) | (F.col("depth") == bits))
    chosen = at.join(fits, ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "bucket", "held")).alias("b"))
    return chosen.select("cell", "b.depth", "b.bucket", "b.held")


def depth_for(total: int, capacity: int, most: int) -> int:
    """Bits of the first directory: about eight cells to a bucket of the wanted size."""
    return min(most, max(1, (max(total, 1) // capacity + 1).bit_length() + 3))
