"""Connected components of an edge table by alternating star contractions."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    # sums of the low hash bits: as many edges with the same ends give the same sum
    low = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))
    return tuple(edges.agg(F.count("*"), F.sum(low)).first())


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component): the smallest id that each end of an edge reaches.

    Every round links each node's larger neighbours, then its smaller ones, to the smallest neighbour
    (large star, small star).  A round is two minima, combined map-side, and two joins; a node of many neighbours
    is never gathered.  The number of rounds grows with the logarithm of the longest path.
    """
    a, b = F.col(left), F.col(right)
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-stars")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(rest.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph with the edges (a, b)."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, label = inverse[: len(a)], inverse[len(a) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
