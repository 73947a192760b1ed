"""Connected components of a link table by alternating stars.

Every round replaces each node's links by links to its smallest neighbour, once towards
larger and once towards smaller nodes, until nothing changes: some log-squared rounds
at most, about five in practice. A round is two joins and aggregations; the links of a
round are a table in the shared folder, so a lost executor repeats one round at most,
and only the count of changed links comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import drop_shared, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of all its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each smaller neighbour of a node, and the node, to the smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node that occurs in a link; root is the smallest node reachable.

    edges: a, b, two columns of one orderable type without nulls, in either direction,
    repeated or not; links of a node to itself are ignored. No links: an empty result.
    """
    held, path = stored(edges.select("a", "b").where("a <> b").distinct(), "links")
    while True:
        after, after_path = stored(_small_star(_large_star(held)).distinct(), "links")
        changed = after.join(held.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")),
                             ["a", "b"], "left_anti").limit(1).count()
        same = not changed and after.count() == held.count()
        drop_shared(edges.sparkSession, path)
        held, path = after, after_path
        if same:
            break
    roots = held.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
