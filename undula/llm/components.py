"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): the smallest node that its edges reach. Edges from a node to itself, and
    those with a null end, make no node.

    Each round lets every node point to its smallest neighbour, follows the pointers twice, and contracts the edges to
    those between different targets, so the edges shrink quickly and a long chain takes few rounds. Minima are pre-aggregated
    in each task, so a node with very many edges is no burden; rounds are cut by written tables; nothing reaches the driver
    but whether edges are left.
    """
    left = written(edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "edges")
    roots = None
    while not left.isEmpty():
        both = left.unionByName(left.selectExpr("b AS a", "a AS b"))
        down = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        down = written(down, "pointers")
        for _ in range(2):
            further = down.select(F.col("node").alias("root"), F.col("root").alias("next"))
            down = down.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        down = written(down, "pointers")
        if roots is None:
            roots = down
        else:
            step = down.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = written(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        a, b = (down.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
        moved = left.join(a, "a", "left").join(b, "b", "left").selectExpr("coalesce(root_a, a) AS a", "coalesce(root_b, b) AS b")
        left = written(moved.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "edges")
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def roots_of(up: np.ndarray) -> np.ndarray:
    while ((further := up[up]) != up).any():
        up = further
    return up


def link(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`up`, the pointers of a small forest, after joining the trees of i[k] and j[k] for all k; roots are the smallest."""
    while len(i):
        up = roots_of(up)
        a, b = up[i], up[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        up = up.copy()
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
    return roots_of(up)
