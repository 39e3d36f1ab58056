"""Connected components of links by alternating stars, each round staged in the shared folder.

Links never come to the driver; a round is aggregations and joins that a hub of any degree passes through partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links lead from the larger to the smaller node."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows node, component for every node with a link; a component is its smallest node. links: columns a, b."""
    edges = scratch.stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before = None
    for k in range(1, MOST_ROUNDS):
        edges = scratch.stage(_small_star(_large_star(edges)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("links did not settle")
    # at rest every link leads to its component's smallest node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
