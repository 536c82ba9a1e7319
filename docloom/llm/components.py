"""Connected components of an edge list by alternating large and small stars.

Every round is two grouped minima with map-side combination and two joins; hubs are
split by the adaptive skew join. Each round's edges are a table in the shared
folder, and only whether they are stars already reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (large) or the smaller neighbours of each node on the least one."""
    near = edges if not large else edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    # A row is a node (hi) and one of its neighbours (lo).
    least = near.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
    hung = near.join(least, "hi")
    if large:
        hung = hung.filter(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    else:
        hung = hung.filter(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(
            least.select("hi", F.col("m").alias("lo"))
        )
    return hung.filter("hi <> lo").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none: then the edges are the components' stars."""
    roles = edges.select(F.col("hi").alias("node"), F.lit(1).alias("hangs")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("hangs")))
    role = roles.groupBy("node").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("least"))
    return role.filter("n > 1 or (n = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge.

    ``edges`` has two long columns, in any direction; self-loops and repeats are allowed.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    now = ws.save(now, f"{name}-0")
    k = 0
    while not _settled(now):
        k += 1
        now = ws.save(_star(_star(now, large=True), large=False), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
