"""Connected components of a graph given as rows.

A task contracts the edges it holds to stars around their least nodes, so afterwards a node hangs on
others at most once for each task, however many edges it had. Edges are then dealt by their larger
end and contracted again until every node hangs on one other: a forest. Nodes climb to their roots by
doubling the step; a root's nodes are dealt over several tasks for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.spread import look_up
from furlong.llm.storage import stored

EDGE = "a long, b long"


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if held:
        nodes, root = roots(*(np.concatenate(side) for side in zip(*held, strict=True)))
        inner = nodes != root
        for low in range(0, int(inner.sum()), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[inner][low : low + (1 << 16)]) for x in (nodes, root)], names=["a", "b"])


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for every node of the pairs (a, b) of two different nodes; a component is
    named by its least node. Pairs with a null are no edges. Every step is a table in the shared
    folder; only counts reach the driver."""
    edges = pairs.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    forest = stored(edges.mapInArrow(_contract, EDGE), "forest")
    while (forest.groupBy("a").count().agg(F.max("count")).first()[0] or 1) > 1:
        forest = stored(forest.repartition("a").mapInArrow(_contract, EDGE), "forest")
    while True:
        higher = forest.select(F.col("a").alias("b"), F.col("b").alias("root"))
        climbs = stored(forest.select("b").distinct().join(higher, "b"), "climbs")
        if not climbs.head(1):
            break
        climbed = look_up(forest, climbs, ["b"], ["a"], "left")
        forest = stored(climbed.select("a", F.coalesce("root", "b").alias("b")), "forest")
    tops = forest.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return forest.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
