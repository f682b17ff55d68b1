"""Connected parts of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.operators.geo import sorted_join
from wayloom.session import checkpointed


def component_roots(links: DataFrame) -> DataFrame:
    """Nodes of links (a, b) with the smallest node of their component: (node, root).

    Every node points at a smaller one of its component. In a round it takes the smallest pointer that its neighbours' pointers
    have, hands it to the node it points at, and skips one step of its own chain; so chains halve, and a path of n links
    takes about log n rounds. A round is a few joins and one minimum per node, and ends in a checkpoint."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = checkpointed(both.distinct())
    state = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("f")))
    while True:
        own = sorted_join(state, state.select(F.col("node").alias("f"), F.col("f").alias("g")), "f")
        seen = sorted_join(both, own.select(F.col("node").alias("v"), "g"), "v").groupBy(F.col("u").alias("node")).agg(F.min("g").alias("m"))
        moves = sorted_join(own, seen, "node").select(F.explode(F.array(F.struct("node", F.least("g", "m").alias("to")), F.struct(F.col("f").alias("node"), F.col("m").alias("to")))).alias("e"))
        best = moves.select("e.*").groupBy("node").agg(F.min("to").alias("to"))
        new = checkpointed(sorted_join(state, best, "node").select("node", F.least("f", "to").alias("f"), (F.col("to") < F.col("f")).alias("moved")))
        state = new.select("node", "f")
        if new.filter("moved").isEmpty():
            return state.withColumnRenamed("f", "root")
