"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir

#: Edges of a set are drawn as a tree with this many branches at most.
BRANCHES = 64


def tree_edges(nodes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the nodes of each root: few steps deep, and no node has more than BRANCHES below it."""
    order = np.lexsort((nodes, roots))
    nodes, roots = nodes[order], roots[order]
    begin = np.searchsorted(roots, roots)
    place = np.arange(len(nodes)) - begin
    below = np.flatnonzero(place > 0)
    return nodes[below], nodes[begin[below] + (place[below] - 1) // BRANCHES]


def _written(df: DataFrame) -> DataFrame:
    """df from a Parquet file in the shared folder: unlike a checkpoint it does not carry its plan's partitionings along, which add up from round to round."""
    path = f"{checkpoint_dir(df.sparkSession)}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges(src, dst); nodes of one component share a root.

    In each round every node points to the neighbour, or itself, with the least
    hash, and edges are redrawn between what their ends point to.  Hashes keep the
    expected number of rounds logarithmic, whatever the order of ids.  At the end
    roots are handed down from round to round, so that rows meet by what they pointed
    to in one round, never all of a component by its root.  Each round is
    written; nothing but emptiness reaches the driver.
    """
    rest = _written(edges.where("src <> dst").select("src", "dst").distinct())
    rounds: list[DataFrame] = []
    while not rest.isEmpty():
        both = rest.union(rest.select("dst", "src"))
        best = F.min(F.struct(F.xxhash64("dst").alias("h"), F.col("dst").alias("node")))
        own = F.struct(F.xxhash64("src").alias("h"), F.col("src").alias("node"))
        points = _written(both.groupBy("src").agg(best.alias("best")).select(F.col("src").alias("at"), F.least("best", own)["node"].alias("to")))
        rounds.append(points)
        left, right = points.select(F.col("at").alias("a"), F.col("to").alias("src")), points.select(F.col("at").alias("b"), F.col("to").alias("dst"))
        moved = rest.select(F.col("src").alias("u"), F.col("dst").alias("v")).join(left, F.col("u") == F.col("a")).join(right, F.col("v") == F.col("b"))
        rest = _written(moved.where("src <> dst").select("src", "dst").distinct())
    roots = None
    for points in reversed(rounds):
        if roots is None:
            roots = points.select(F.col("at").alias("node"), F.col("to").alias("root"))
        else:
            above = roots.select(F.col("node").alias("above"), F.col("root").alias("top"))
            roots = points.join(above, F.col("to") == F.col("above"), "left").select(F.col("at").alias("node"), F.coalesce("top", "to").alias("root"))
    return _written(roots) if roots is not None else rest.select(F.col("src").alias("node"), F.col("dst").alias("root"))
