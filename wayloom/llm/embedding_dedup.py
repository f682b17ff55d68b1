"""Near-dedup of embeddings: sign hashes of random hyperplanes in several tables, cosines checked, connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.shared import components, stored

COSINE = 0.95
RECALL = 0.999
BUCKET = 512
LEAST_BITS, MOST_BITS = 8, 40
BLOCK = 1024
_SEED = 20240711
_STEP = 256
_HASHED = "a long, b long, rep_id long, copies long, dim int, codes array<long>, vector binary"
_FOUND = "a long, b long, rep_id long, links long, root long"


def plan_tables(vectors: int, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, tables): bits so that spread-out vectors fill a bucket with about `bucket`, tables so that a pair exactly at the
    threshold meets in one of them with a probability of at least `recall`, however many vectors there are.

    A random hyperplane parts two vectors at angle t with probability t / pi."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(vectors, 1) / bucket))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, 1 if together >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def units(block: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; the largest component goes to one first, so that no square overflows."""
    block = block.astype(np.float64)
    block = block / np.abs(block).max(axis=1)[:, None]
    return block / np.sqrt((block * block).sum(axis=1))[:, None]


def by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column that can be compared, with their values, a dimension at a time: null, empty and zero vectors and
    those with null or non-finite components cannot."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        block = values[starts[rows][:, None] + np.arange(dim)]
        largest = np.abs(block).max(axis=1)
        good = np.isfinite(largest) & (largest > 0)
        if good.any():
            yield rows[good], block[good]


def sign_codes(block: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """For each row and table the sides of `bits` hyperplanes, as one number; hyperplanes depend on the dimension alone."""
    planes = np.random.default_rng([_SEED, block.shape[1]]).standard_normal((block.shape[1], tables * bits))
    sides = (units(block) @ planes > 0).reshape(len(block), tables, bits)
    return sides @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def hashed(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """Comparable vectors of reps (a, b, rep_id, copies, embedding), with their code in every table."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in by_dimension(batch.column("embedding")):
                codes = sign_codes(block, bits, tables)
                bounds = pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32))
                kept = [batch.column(c).take(pa.array(rows)) for c in ("a", "b", "rep_id", "copies")]
                vectors = pa.array([x.tobytes() for x in block], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(np.full(len(rows), block.shape[1], np.int32)), pa.ListArray.from_arrays(bounds, pa.array(codes.ravel())), vectors],
                    ["a", "b", "rep_id", "copies", "dim", "codes", "vector"],
                )

    return reps.select("a", "b", "rep_id", "copies", "embedding").mapInArrow(code, _HASHED)


def local_roots(n: int, i: np.ndarray, j: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """The smallest place that each of n places is connected with by the links (i, j), on top of earlier roots."""
    roots = np.arange(n) if roots is None else roots
    while True:
        least = np.minimum(roots[i], roots[j])
        new = roots.copy()
        for side in (i, j, roots[i], roots[j]):
            np.minimum.at(new, side, least)
        new = new[new]
        if np.array_equal(new, roots):
            return roots
        roots = new


def compared(cosine: float, dtype: str) -> Callable[[pa.Table], pa.Table]:
    """What a task does with one block pair of a bucket: counts of links for each vector, and the first vector it hangs on.

    A pair that shares an earlier table's bucket was counted there. Cosines fill one matrix of a few hundred rows at a time."""

    def meet(rows: pa.Table) -> pa.Table:
        n, at = rows.num_rows, rows["place"][0].as_py()
        a, b, ids, copies, side = (rows[c].to_numpy() for c in ("a", "b", "rep_id", "copies", "side"))
        codes = rows["codes"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        vectors = units(np.frombuffer(b"".join(rows["vector"].to_pylist()), dtype).reshape(n, -1))
        one = rows["low"][0].as_py() == rows["high"][0].as_py()
        left, right = (np.arange(n), np.arange(n)) if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links, roots = np.zeros(n, np.int64), np.arange(n)
        for lo in range(0, len(left), _STEP):
            own = left[lo : lo + _STEP]
            i, j = np.nonzero(vectors[own] @ vectors[right].T >= cosine)
            i, j = own[i], right[j]
            new = i < j if one else np.ones(len(i), bool)
            for table in range(at):
                new &= codes[i, table] != codes[j, table]
            i, j = i[new], j[new]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            roots = local_roots(n, i, j, roots)
        linked = np.flatnonzero(links)
        return pa.table({"a": a[linked], "b": b[linked], "rep_id": ids[linked], "links": links[linked], "root": ids[roots[linked]]})

    return meet


def linked(vectors: DataFrame, cosine: float, dtype: str, block: int = BLOCK) -> DataFrame:
    """Of hashed vectors: (a, b, rep_id, links, root), one row for each block pair in which a vector has new links.

    A bucket with more than `block` vectors is cut into blocks by hash, and each two of its blocks meet in a group of their
    own, so that a group never has more than about 2 * block rows."""
    posted = vectors.select("*", F.posexplode("codes").alias("place", "code"))
    keys = ["dim", "place", "code"]
    large = stored(posted.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > block), "vectors-large")
    cut = posted.join(large, keys, "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("a", "b"), "parts").cast("int")
    met = cut.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    met = met.select(
        *keys, F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"),
        "a", "b", "rep_id", "copies", "codes", "vector",
    )
    return met.groupBy(*keys, "low", "high").applyInArrow(compared(cosine, dtype), _FOUND)


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Every row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors are linked when they meet in a bucket of one of the sign-hash tables and their cosine, in double precision over
    all components, is at least `cosine`; a pair at the threshold is found with a probability of `recall`, a closer one with
    a higher one, at every number of vectors (see plan_tables). n_links counts the other rows linked directly, component_id is
    the smallest vec_id reachable, itself included. Equal vectors are always linked: they are folded to one before and
    counted as its copies, so a vector with very many copies costs one row.

    Null, empty and zero vectors and those with null or non-finite components are linked with nothing, nor are vectors of
    different dimensions. Rows that share a vec_id are one vertex: what either reaches, both do; n_links stays by row. A null
    vec_id keeps its row, with no links and a null component. No rows give no rows; further columns are not read.
    """
    double = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    embedding = F.col("embedding").cast(double)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"))
    rows = rows.withColumns({"a": F.xxhash64("embedding"), "b": F.xxhash64(F.lit(7), "embedding", F.size("embedding"))})
    named = rows.filter("vec_id is not null")
    reps = stored(named.groupBy("a", "b").agg(F.min("vec_id").alias("rep_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "vectors-distinct")
    bits, tables = plan_tables(reps.count(), cosine, recall, bucket)
    coded = stored(hashed(reps, bits, tables), "vectors-coded")
    found = stored(linked(coded, cosine, "float32" if double == "array<float>" else "float64", block), "vectors-linked")

    members = named.select("vec_id", "a", "b")
    folded = coded.select("a", "b", "rep_id", "copies").join(found.groupBy("a", "b").agg(F.sum("links").alias("links")), ["a", "b"], "left")
    known = stored(members.join(folded, ["a", "b"], "left"), "vectors-members")
    doubled = known.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id")
    # Copies hang on the first of them, unless a vec_id stands in several rows and so ties vectors together.
    ties = known.filter("rep_id is not null and vec_id <> rep_id").join(doubled, "vec_id", "left_semi").select(F.col("rep_id").alias("a"), F.col("vec_id").alias("b"))
    grouped = components(found.select(F.col("root").alias("a"), F.col("rep_id").alias("b")).unionByName(ties))
    answer = (
        known.withColumn("node", F.coalesce("rep_id", "vec_id")).join(grouped, "node", "left")
        .select(
            "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
    nameless = rows.filter("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return answer.unionByName(nameless)


OP11_SQL = """
WITH RECURSIVE given AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), units AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM given
  WHERE e IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= 0.95
), reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
), parts AS (
  SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN parts p USING (vec_id)
"""
