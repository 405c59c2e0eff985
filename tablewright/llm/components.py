"""Connected components of an edge table, by alternating star operations on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import cut_lineage

#: tasks that the edges of one node are spread over
SALTS = 64


def with_least(links: DataFrame) -> DataFrame:
    """``links`` (u, v and more) with m, the smallest v of each u. The edges of a hub meet in ``SALTS`` groups, never in one:
    a group gives one minimum, and the smallest of at most ``SALTS`` minima goes back to each group."""
    spread = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = spread.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"))
    return spread.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"]).select(*links.columns, "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Every node first hands its larger neighbours to its smallest one, then its smaller neighbours and itself;
    edges end as stars after about a logarithmic number of rounds. Each round is written to the shared
    checkpoint folder; only two numbers a round come to the driver.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        n = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (n.n, n.h) == state or not n.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = (n.n, n.h)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        joined = with_least(large)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.where("u <> v").distinct())


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component among 0..n-1, inside a task."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            return root
    return root
