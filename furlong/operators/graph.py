"""Bounded breadth-first search over a stored edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.session import checkpoint


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, node: str = "node", checkpoint_every: int = 3) -> DataFrame:
    """Depth of every node reachable within ``max_depth`` steps.

    ``edges`` has src and dst. Each level is one join of the frontier with the edges and one
    anti-join with what was seen; lineage is cut every few levels, so the plan stays small.
    """
    seen = seeds.select(F.col(node)).distinct().withColumn("depth", F.lit(0))
    frontier = seen.select(node)
    for level in range(1, max_depth + 1):
        reached = (
            edges.join(frontier, edges["src"] == frontier[node], "left_semi")
            .select(F.col("dst").alias(node))
            .distinct()
            .join(seen.select(node), node, "left_anti")
            .withColumn("depth", F.lit(level))
        )
        if level % checkpoint_every == 0 and level < max_depth:
            reached = checkpoint(reached)
            seen = checkpoint(seen.unionByName(reached))
        else:
            seen = seen.unionByName(reached)
        frontier = reached.select(node)
    return seen
