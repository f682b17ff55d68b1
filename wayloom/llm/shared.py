"""Small helpers of the training-data operators: tables in the shared folder, text normalising, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.session import checkpointed, ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the folder that spark.checkpoint.dir names, and read it back: its lineage ends there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: it is sorted and exchanged. The planner goes by the compressed size of files and
    exchanges, and would collect many times as much on the driver to broadcast it."""
    return df.hint("merge")


def _stars(edges: DataFrame) -> bool:
    below = edges.groupBy("v").agg(F.count("*").alias("n"))
    tops = edges.select(F.col("u").alias("v")).distinct().withColumn("top", F.lit(True))
    return below.join(tops, "v", "left").filter("n > 1 or top").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root being the smallest node of the component.

    Alternating large-star and small-star steps; each only joins edges with one minimum per node, so a node with very many
    edges stays spread over tasks. Ends when every node has one edge, to a node that has none itself. Loops and repeated
    edges are allowed; nodes of loops alone are not returned.
    """
    edges = checkpointed(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    )

    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        edges = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        least = edges.groupBy("v").agg(F.min("u").alias("m"))
        edges = checkpointed(
            edges.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
            .select("e.v", "e.u").filter("v <> u").distinct()
        )
    roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
