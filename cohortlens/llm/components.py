"""Connected components of an edge table: alternating large and small stars, no edge list on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import stored


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: a count and a sum of hashes, two numbers for the driver."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (u, v); the root is the component's smallest node.

    Each round keeps the components and replaces edges by edges to smaller nodes, until all edges
    lead to the roots. Rounds grow with the logarithm of the longest chain. Null ends are dropped,
    an edge from a node to itself names the node alone. A round's edges are a written table.
    """
    edges = edges.where("u is not null and v is not null")
    now = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        # Large star: larger neighbours of a node move to its smallest neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours of a node, and the node, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        following = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(following)
        now, done, state = following, after == state, after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = nodes.select(F.col("root").alias("node"), "root").distinct()
    return nodes.unionByName(roots)
