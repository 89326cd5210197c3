"""Connected components of a graph of links, without a task or driver that holds all of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import join_skewed, materialize


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes and links i-j, the smallest node that each can reach."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        old = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (old == label).all():
            break
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for each node of the links (a, b); links to itself count.

    Alternates the large-star and the small-star step, each a minimum per node and a join back, until the links no
    longer change; every round's links are cut off through the checkpoint folder. Rounds grow as the logarithm of the longest path. The links of a
    node with very many neighbours are not shuffled to it, but their minimum is sent to them.
    """

    def star(directed: DataFrame, total: int) -> DataFrame:
        """From (u, v) with v a neighbour: u, v and the least of u and its neighbours."""
        least = directed.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        return join_skewed(directed, least, "u", "n", total)

    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        large = star(both, 2 * mark[0]).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        loops = now.filter(F.col("u") == F.col("v"))
        large = large.union(loops).distinct()
        small = star(large, mark[0])
        now = materialize(
            small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v"))).distinct()
        )
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(
        now.filter(F.col("u") != F.col("v")).select("v", "v").distinct().toDF("node", "root")
    ).groupBy("node").agg(F.min("root").alias("root"))
