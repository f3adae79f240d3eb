"""Connected components of an edge table, without collecting any group of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import stage


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)``; root is the least node of the component.

    Alternates two minimum-only rewrites of the edges: every neighbour above a
    node moves to the least neighbour (large star), then every node's smaller
    neighbours move to the least of them (small star). Both are a grouped
    minimum and a join, so a node with very many edges costs partial
    aggregation and a join. The minima are written first: a join with an
    exchange of its own on either side is one that adaptive execution can split.
    Each round is written to the shared folder. No edges give no rows; loops and repeated
    edges have no effect; rows with a null are ignored.
    """
    now = stage(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u and a is not null and b is not null").distinct(), "edges"
    )
    before = None
    for _ in range(most_rounds):
        both = now.select(F.col("v").alias("n"), F.col("u").alias("w")).union(now.select("u", "v"))
        least = stage(both.groupBy("n").agg(F.min("w").alias("m")).select("n", F.least("n", "m").alias("m")), "least")
        large = stage(both.where("w > n").join(least, "n").select(F.col("w").alias("v"), F.col("m").alias("u")).distinct(), "large")
        least = stage(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        joined = large.join(least, "v")
        small = joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u"))).distinct()
        now = stage(small, "star")
        after = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)
