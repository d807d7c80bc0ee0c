"""Connected components of a table of links, by joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_sized, written


def forest(label: np.ndarray, links: list[tuple]) -> np.ndarray:
    """``label`` (the smallest known position reachable from each) after further links."""
    if not links:
        return label
    u, v = (np.concatenate(x) for x in zip(*links))
    label = label.copy()
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each linked node's component.

    Large-star and small-star steps in turn: every step keeps at most one link a node and its
    neighbours, and their number falls with the logarithm of the longest chain. Only distances to the
    smallest neighbour are aggregated, so a node with many links is no single group; each step is
    written to the shared folder, which cuts the lineage. Links with a null end are left out.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v")
    pairs = written(pairs.distinct(), "links")
    while True:
        large = written(_star(pairs, True), "large-star")
        small = written(_star(large, False), "small-star")
        # A star forest: no node is both below and above another, and each is below one only.
        inner = small.select(F.col("v").alias("u")).distinct().join(small, "u", "left_semi")
        forked = small.groupBy("u").count().where("count > 1")
        pairs = small
        if inner.isEmpty() and forked.isEmpty():
            break
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large star) or smaller (small star) neighbours of a node to its smallest one.

    ``pairs`` holds (u, v) with u > v.
    """
    if large:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).withColumn("m", F.least("m", "u"))
    least = written(least, "least-neighbours")
    # A hub has many links.
    moved = join_sized(both, least, "u", "size")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()
