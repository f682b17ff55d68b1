"""Exact dedup by an extendible-hash index on shared files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wayloom.llm.extendible import depth_for, directory
from wayloom.llm.shared import lowered, stored

CAPACITY = 4096
MOST_BITS = 20


def normalised(text: Column) -> Column:
    """A-Z lower-cased, null as empty; a text of ASCII alone takes the quick way to the same result."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(lowered(text))


def exact_directory(digests: DataFrame, capacity: int = CAPACITY, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """The directory (cell, depth, bucket, slices) and its bits, from how many rows each hash prefix holds.

    `capacity` is rows to a bucket, up to 2^most_bits cells. A cell that is fuller alone, as that of a text with very many copies,
    keeps one bucket whose rows come in as many slices as they fill.
    """
    bits = depth_for(digests.count(), capacity, most_bits)
    cells = digests.groupBy(_cell(F.col("key"), bits).alias("cell")).agg(F.count("*").alias("size"))
    found = directory(cells, 0, bits, capacity).select("cell", "depth", "bucket", F.ceil(F.col("held") / capacity).alias("slices"))
    return stored(found, "exact-directory"), bits


def _placed(rows: DataFrame, buckets: DataFrame, bits: int) -> DataFrame:
    """Rows with a hash key and the bucket that the directory names for it."""
    # At most 2^most_bits rows of four numbers.
    return rows.withColumn("cell", _cell(F.col("key"), bits)).join(F.broadcast(buckets), "cell").drop("cell")


def exact_index(docs: DataFrame, buckets: DataFrame, bits: int) -> DataFrame:
    """The index: one entry for each distinct text, with its bucket, hash key, place in the key's chain and kept document.

    Rows travel to the owner of their bucket and nowhere else before. There texts of one key are compared byte for byte, equal
    ones fold into an entry, and the entries of a key are chained. The slices of an overfull bucket are folded by as many
    tasks; of each slice one row a text goes on, with the text, to the owner, who compares them again.
    """
    rows = _placed(docs.select("doc_id", normalised(F.col("text")).alias("n")).withColumn("key", F.xxhash64("n")), buckets, bits)
    sent = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(7)), "slices")).repartition("depth", "bucket", "slice")
    folded = sent.groupBy("depth", "bucket", "slice", "slices", "key", "n").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    owned = folded.select("depth", "bucket", "key", F.sha2("n", 256).alias("text_sha256"), F.when(F.col("slices") > 1, F.col("n")).alias("n"), "keep_id", "group_size").repartition("depth", "bucket")
    entries = owned.groupBy("depth", "bucket", "key", "text_sha256", "n").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chain = Window.partitionBy("depth", "bucket", "key").orderBy("text_sha256")
    return stored(entries.withColumn("chain", F.row_number().over(chain) - 1).drop("n"), "exact-index")


def _cell(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, most_bits: int = MOST_BITS) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, bucket, depth, chain.

    Texts are equal when they are identical after lower-casing A-Z only; null counts as empty. Of equal texts the largest
    doc_id stays. Rows that repeat the doc_id which stays are all kept, since doc_id is what names a document. A null doc_id
    loses to any other; where a group has only nulls, keep_id is null and all of them are kept. No rows give no rows; other
    columns, whatever their names, are not read. Rows probe the index by the bucket that the directory names, then by key and
    along its chain by digest.
    """
    docs = docs.select("doc_id", "text")
    n = normalised(F.col("text"))
    digests = stored(docs.select("doc_id", n.alias("n")).select("doc_id", F.xxhash64("n").alias("key"), F.sha2("n", 256).alias("text_sha256")), "exact-digests")
    buckets, bits = exact_directory(digests, capacity, most_bits)
    probes = _placed(digests, buckets, bits).drop("slices")
    return probes.join(exact_index(docs, buckets, bits), ["depth", "bucket", "key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "depth", "chain"
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with the columns of docs. Rows are told apart by doc_id and text, so a doc_id that
    stands for several texts loses only those that another document keeps, and a null doc_id goes where a document keeps its text."""
    gone = exact_dedup(docs).filter("not kept").select("doc_id", "text_sha256").distinct().alias("g")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.sha2(normalised(F.col("d.text")), 256) == F.col("g.text_sha256"))
    return docs.alias("d").join(gone, same, "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])


OP1_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""
