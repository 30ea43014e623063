"""Connected components of a graph given as an edge table.

Alternating large-star and small-star steps: every step is a grouped minimum
(pre-aggregated before its shuffle) joined back to the edges, so a node with very many
neighbours is never gathered in one task, and the number of rounds grows with the
logarithm of the longest path.  Each round's edges are checkpointed in the
session's checkpoint folder; only counts come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrant.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns u, v, any one orderable
    type); label is the smallest node it is connected to.  Self-loops, nulls and
    repeated edges add nothing."""
    links = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    state = None
    while True:
        links = materialize(_small_star(_large_star(links)))
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state or now["n"] == 0:
            break
        state = now
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        roots.select("node", F.col("node").alias("label")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    up = both.filter("v > u").join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c"))
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    down = links.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c"))
    moved = down.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
