"""Connected components of an edge list, on the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfold.llm.common import cut, drop_old_rounds


def local_roots(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each of n nodes' component, after the links a-b join what ``roots`` has."""
    roots = np.arange(n) if roots is None else roots
    while True:
        x, y = roots[a], roots[b]
        apart = x != y
        if not apart.any():
            return roots
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(roots, np.maximum(x, y), low)  # hang the larger root below the smaller
        while True:
            up = roots[roots]
            if np.array_equal(up, roots):
                break
            roots = up


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node reachable.

    ``edges`` has bigint columns u, v.  Large-star and small-star steps in turn:
    each relinks nodes to the smallest neighbour, which needs a logarithmic
    number of rounds.  Minima are aggregated before they move, and they are cut
    from their lineage so that the join back to a hub's links can be split.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        del both, low, large, small
        drop_old_rounds(now.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
