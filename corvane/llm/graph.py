"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Each round joins nodes with the least neighbour, which is aggregated before the shuffle; a hub
    is one row on that side, and adaptive execution splits the other. Rounds grow as the
    logarithm of the longest path. Every round is checkpointed. No edges: no rows.
    """
    now = edges.select("a", "b").filter("a <> b")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        base = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(base, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = cut(small.unionByName(base.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
