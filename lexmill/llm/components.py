"""Connected components of a distributed edge list by alternating large and small stars.

Every round is two aggregates and two joins over the edges, never a list of a vertex's neighbours, so a vertex with
any number of edges costs a skewed join (which adaptive execution splits) and no more. Rounds grow with the square of
the logarithm of a component's size. Each round is a table in the shared folder: a lost executor repeats one round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.storage import written


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of any ordered type -> (node, root) for each node with an edge to another; root is the smallest node
    of its component. Self-loops and repeats are ignored; rows with a null end are dropped, as they link nothing."""
    e = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = written(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small")
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


class Forest:
    """Union-find over 0..n-1 that takes links as arrays; labels are the smallest index reached."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label, nxt := label[label]):
                label[:] = nxt

    def spanning(self) -> tuple[np.ndarray, np.ndarray]:
        """A link from each index to its label, without those that are their own."""
        own = np.flatnonzero(self.label != np.arange(len(self.label)))
        return own, self.label[own]
