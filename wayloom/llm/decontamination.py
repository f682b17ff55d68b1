"""Benchmark decontamination: size-partitioned MinHash containment search, verified on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.bits import bit_filter, passes
from wayloom.llm.shared import stored
from wayloom.llm.shingles import WIDTH, row_groups, shingle_hashes

PERCENT = 75


def _hashes(df: DataFrame, key: str, width: int, wanted: np.ndarray | None = None) -> DataFrame:
    """The distinct shingle hashes of each text, those the bit filter lets through, with the size of the whole set.

    A row whose text has hits comes as one row for each of them; the size is that of the set before filtering.
    """
    name = key

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in row_groups(batch.column("text")):
                values, runs = shingle_hashes(data, bounds, width)
                take = np.arange(len(values)) if wanted is None else np.flatnonzero(passes(wanted, values))
                if not len(take):
                    continue
                row = np.searchsorted(np.cumsum(runs), take, "right")
                first = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1, len(row)]
                rows, found, sizes = [], [], []
                ends = np.cumsum(runs)
                for s, e in zip(first[:-1], first[1:], strict=True):
                    r = row[s]
                    own = np.unique(values[take[s:e]])
                    found.append(own)
                    rows.append(np.full(len(own), r))
                    sizes.append(np.full(len(own), len(np.unique(values[ends[r] - runs[r] : ends[r]]))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(name)[lo:hi].take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(found).view(np.int64))],
                    [name, "set_size", "shingle"],
                )

    return df.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(hashes, f"{key} long, set_size long, shingle long")


def item_signatures(benchmark: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Every shingle of every item: item_id, n, need, size_class, matches, shingle, in_signature.

    Items of 2^c to 2^(c+1) - 1 shingles form size class c, which has a signature length of its own: an eighth of 2^c, one at
    least, more than the shingles that the largest item of the class may lack. The signature of an item is its bottom-k MinHash
    sketch, the hashes that are smallest, k being that length. A document with `need` of the n shingles lacks n - need of
    them, so that it holds `matches` = k - (n - need) of the signature for certain: the search loses nothing.
    """
    shingles = _hashes(benchmark.filter("item_id is not null"), "item_id", width).groupBy("item_id", "shingle").agg(F.max("set_size").alias("n"))
    whole = shingles.groupBy("item_id").agg(F.sort_array(F.collect_list("shingle")).alias("all")).withColumn("n", F.size("all").cast("long"))
    sized = whole.withColumn("need", _share("n", percent)).withColumn("size_class", F.length(F.bin("n")) - 1)
    sized = sized.withColumn("least", F.expr("shiftleft(1L, size_class)")).withColumn("largest", F.expr("2 * least - 1"))
    sized = sized.withColumn("k", F.least("n", F.col("largest") - _share("largest", percent) + F.greatest(F.lit(1), F.shiftright("least", 3))))
    return sized.select(
        "item_id", "n", "need", "size_class", (F.col("k") - F.col("n") + F.col("need")).alias("matches"), "k", F.posexplode("all").alias("rank", "shingle")
    ).withColumn("in_signature", F.col("rank") < F.col("k")).drop("rank", "k")


def _share(n: str, percent: int) -> Column:
    return F.expr(f"({n} * {percent} + 99) div 100")


def candidates(sketches: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id) whose sketches agree in as many hashes as the item's size class asks for.

    A document has a sketch for each class: its hashes up to the largest of any signature of the class. Classes are at most 63.
    """
    signed = items.filter("in_signature").select("size_class", "item_id", "matches", "shingle")
    cuts = signed.groupBy("size_class").agg(F.max("shingle").alias("last")).collect()
    if not cuts:
        return items.select(F.lit(None).cast("long").alias("doc_id"), "item_id").limit(0)
    classes = F.array(*[F.when(F.col("shingle") <= F.lit(c["last"]), F.lit(c["size_class"])) for c in cuts])
    by_class = sketches.select("doc_id", "shingle", F.explode(F.array_compact(classes)).alias("size_class"))
    agreeing = by_class.join(signed, ["size_class", "shingle"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("agree"), F.max("matches").alias("matches"))
    return agreeing.filter("agree >= matches").select("doc_id", "item_id")


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Pairs (doc_id, item_id, n, common): documents with at least `percent` of an item's distinct `width`-word shingles.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; an item of fewer words is one shingle and must be a whole
    document of as few words. Documents are read once: hashes that some item may have pass a bit filter of fixed size. Their
    sketches are searched size class by size class; of the candidates, and of no other pair, the common shingles are counted on
    whole sets. Items without words, null ids, and null or empty texts match nothing; rows of one doc_id count as one document,
    rows of one item_id as one item.
    """
    items = stored(item_signatures(benchmark, percent, width), "bench-items")
    hits = stored(_hashes(docs.filter("doc_id is not null"), "doc_id", width, bit_filter(items, "shingle")).select("doc_id", "shingle").distinct(), "bench-hits")
    pairs = stored(candidates(hits, items), "bench-candidates")
    wanted = pairs.join(items.select("item_id", "n", "need", "shingle"), "item_id")
    return (
        wanted.join(hits, ["doc_id", "shingle"]).groupBy("doc_id", "item_id", "n", "need").agg(F.count("*").alias("common"))
        .filter("common >= need").select("doc_id", "item_id", "n", "common")
    )


def decontamination(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Every row of docs (doc_id, text) with contaminated, n_items, item_ids (ascending) and best, the largest share of an item.

    See contained_items. Clean documents have false, 0, an empty list and 0.0. The list is as long as the benchmark at most.
    """
    found = contained_items(docs, benchmark, percent, width).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("common") / F.col("n")).alias("best")
    )
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("best", F.lit(0.0)).alias("best"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with the columns of docs."""
    return docs.join(contained_items(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
