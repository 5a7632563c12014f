"""Connected components by alternating large-star and small-star steps.

Edges stay distributed. The large-star step reduces each node's neighbours to one minimum by
map-side aggregation and writes these minima before the many edges meet them: Spark then knows
their size, sends small ones to all tasks and can split a node with very many edges, neither of
which it can do on top of an aggregation. (In the small-star step a node meets its smaller
neighbours alone, and large-star has left few of them.) The steps end when every edge leads
from a node to its root; nothing of the edges comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = _down(edges)
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a root, and no root has one."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    between = edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return several.unionByName(between).isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u, v) of any one orderable type; returns (node, root) of every node with an edge,
    root the smallest node of its component, as a written table. An edge from a node to itself
    or a null end is no edge; without edges there are no rows."""
    edges = written(_down(edges.where("u != v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _stars(edges):
            break
        edges = written(_small(_large(edges)), "edges")
    else:
        raise RuntimeError("components did not converge")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return written(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
