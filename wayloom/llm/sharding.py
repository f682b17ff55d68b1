"""Sharding by extendible hashing: shards are hash prefixes, and only an oversized one splits on a further bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wayloom.llm.extendible import HASH_BITS, depth_for, directory, hash60, prefix
from wayloom.llm.shared import stored

BYTE_LIMIT = 1 << 20
MOST_BITS = 20
LEVEL_BITS = 10


def shard_assignment(docs: DataFrame, byte_limit: int = BYTE_LIMIT, columns: list[str] | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """Every row of docs (doc_id, text): row (a struct of `columns`, by default doc_id alone), n_bytes, shard, depth, page, shard_bytes, oversize.

    The hash is the first 60 bits of the MD5 of doc_id as text, n_bytes the UTF-8 length of text (null: 0). `shard` spells the
    hash prefix in bits, of `depth` bits (none for the only shard), so shards are disjoint ranges of the hash. A shard holds
    byte_limit bytes at most. Rows of one doc_id cannot be parted by hash: where they are over the limit they are dealt to
    numbered pages of the shard (page 0 elsewhere); a row over half the limit has its page alone, and a row over the limit
    is the only one in its shard and marked oversize. A null doc_id hashes as empty text. No rows give no rows.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in columns or ["doc_id"]]).alias("row")
    rows = docs.select(
        F.monotonically_increasing_id().alias("at"), hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"),
        F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"), carried,
    )
    rows = stored(rows, "shard-rows")
    above, bits = 0, depth_for(rows.agg(F.sum("n_bytes")).first()[0] or 0, byte_limit, most_bits)
    left, done = rows.select("h", "n_bytes"), []
    while True:
        cells = left.groupBy(prefix(F.col("h"), bits).alias("cell")).agg(F.sum("n_bytes").alias("size"))
        found = stored(directory(cells, above, bits, byte_limit).withColumn("bits", F.lit(bits)), "shard-directory")
        open_cells = found.filter((F.col("held") > byte_limit) & (F.col("depth") == bits)).select("cell")
        done.append((bits, found if bits == HASH_BITS else found.filter((F.col("held") <= byte_limit) | (F.col("depth") < bits))))
        if bits == HASH_BITS or open_cells.isEmpty():
            break
        left = left.join(open_cells, prefix(F.col("h"), bits) == F.col("cell"), "left_semi")
        above, bits = bits + 1, min(HASH_BITS, bits + LEVEL_BITS)
    parts = [rows.join(found, prefix(F.col("h"), b) == F.col("cell")) for b, found in done]
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    bounded = placed.filter(F.col("held") <= byte_limit).withColumn("page", F.lit(0).cast("long")).withColumn("shard_bytes", F.col("held"))
    result = bounded if len(done) == 1 or done[-1][0] < HASH_BITS else bounded.unionByName(_paged(placed.filter(F.col("held") > byte_limit), byte_limit))
    return result.select(
        "row", "n_bytes", F.expr("substring(lpad(conv(bucket, 10, 2), 60, '0'), 61 - depth, depth)").alias("shard"), "depth", "page", "shard_bytes", (F.col("shard_bytes") > byte_limit).alias("oversize")
    )


def _paged(full: DataFrame, byte_limit: int) -> DataFrame:
    """Rows of one hash over several pages, by their place in the sum of bytes; each window holds the rows that one task read."""
    half = byte_limit // 2
    small = full.filter(F.col("n_bytes") <= half).withColumn("part", F.shiftrightunsigned("at", 33))
    sums = small.groupBy("bucket", "part").agg(F.sum("n_bytes").alias("s"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bucket", "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("n_bytes").over(within), F.lit(0))
    dealt = small.join(offsets, ["bucket", "part"]).withColumn("page", F.floor(start / max(1, half)).cast("long")).drop("part", "offset")
    alone = full.filter(F.col("n_bytes") > half).withColumn("page", -1 - F.col("at"))
    pages = dealt.unionByName(alone)
    sizes = pages.groupBy("bucket", "page").agg(F.sum("n_bytes").alias("shard_bytes"))
    return pages.join(sizes, ["bucket", "page"])


def write_shards(docs: DataFrame, path: str, byte_limit: int = BYTE_LIMIT) -> None:
    """All rows and columns of docs as Parquet below path, a folder for each shard and page."""
    placed = shard_assignment(docs, byte_limit, docs.columns)
    placed = placed.withColumn("shard_name", F.concat_ws("-", F.when(F.col("shard") == "", "all").otherwise(F.col("shard")), F.col("page").cast("string")))
    placed.repartition("shard_name").sortWithinPartitions("shard_name").select("row.*", "shard_name").write.partitionBy("shard_name").parquet(path)


OP9_SQL = f"""
WITH r AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h, strlen(coalesce(text, '')) AS n_bytes
  FROM documents),
p AS (
  SELECT d AS depth, h >> (60 - d) AS bucket, sum(n_bytes)::BIGINT AS held
  FROM r, (SELECT unnest(range(0, 61)) AS d) GROUP BY ALL),
f AS (
  SELECT doc_id, n_bytes, min(p.depth) AS depth
  FROM r JOIN p ON r.h >> (60 - p.depth) = p.bucket WHERE p.held <= {BYTE_LIMIT} OR p.depth = 60 GROUP BY ALL)
SELECT f.doc_id, f.n_bytes, substr(right(lpad(bin(r.h), 60, '0'), 60), 1, f.depth::INT) AS shard, f.depth::INT AS depth, 0::BIGINT AS page,
  p.held AS shard_bytes, p.held > {BYTE_LIMIT} AS oversize
FROM f JOIN r USING (doc_id) JOIN p ON p.depth = f.depth AND p.bucket = r.h >> (60 - f.depth)"""
