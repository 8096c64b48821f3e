"""Connected components of a graph given as edges between BIGINT nodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqstream.plans.stage import stage


class Forest:
    """Groups of positions; the root is the smallest position."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of `edges` (a, b); root is the smallest node reached.

    Each round points every node to its smallest neighbour, doubles the pointers
    until they meet a root, and contracts the edges to roots. Every step is a
    partial aggregation or a join on nodes, written to the shared folder.
    """
    left = stage(edges.select("a", "b").where("a <> b").distinct())
    levels: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.union(left.select("b", "a")).toDF("node", "other")
        parents = stage(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("root")))
        while True:
            up = parents.toDF("root", "up")
            jumped = stage(parents.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            parents = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        levels.append(parents)
        at_a, at_b = parents.toDF("a", "ra"), parents.toDF("b", "rb")
        joined = left.join(at_a, "a").join(at_b, "b").where("ra <> rb")
        left = stage(joined.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if not levels:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    result = levels[0]
    for level in levels[1:]:
        up = level.toDF("root", "up")
        result = result.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return result
