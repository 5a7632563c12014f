"""The category tree as a closure table, expansion to integrations, and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLOSURE = "ancestor string, descendant string, depth int"


def closure(spark: SparkSession, tree: dict[str, dict]) -> DataFrame:
    """Ancestor-or-self pairs of a nested {id: {name, children}} tree. A tree is a
    configuration file, walked on the driver."""
    rows: list[tuple[str, str, int]] = []

    def walk(nodes: dict[str, dict], above: list[str]) -> None:
        for name, node in nodes.items():
            path = [*above, name]
            rows.extend((a, name, len(path) - 1 - k) for k, a in enumerate(path))
            walk(node.get("children") or {}, path)

    walk(tree, [])
    return spark.createDataFrame(rows, CLOSURE)


def integrations(categories: list[str] | None, connectivity: list[str] | None, tree: DataFrame, dimension: DataFrame) -> DataFrame:
    """integration: those in any of the categories or below, and of any of the connectivities.
    ``dimension``: integration, categories (array), connectivity."""
    found = dimension
    if categories is not None:
        below = tree.where(F.col("ancestor").isin(categories)).select("descendant").distinct()
        found = found.join(dimension.select("integration", F.explode("categories").alias("descendant")).join(below, "descendant", "left_semi").select("integration").distinct(), "integration", "left_semi")
    if connectivity is not None:
        found = found.where(F.col("connectivity").isin(connectivity))
    return found.select("integration").distinct()


def integrations_of(categories: list[str] | None, connectivity: list[str] | None, tree: DataFrame, dimension: DataFrame) -> list[str] | None:
    """``integrations`` as a filter's argument, a list of names of the integration manifest. None
    if neither is asked for; an empty list matches nothing."""
    if categories is None and connectivity is None:
        return None
    return sorted(r[0] for r in integrations(categories, connectivity, tree, dimension).collect())


def rollup(counts: DataFrame, membership: DataFrame, tree: DataFrame) -> DataFrame:
    """``counts``: integration, count. ``membership``: integration, category. Each category's
    count goes to all its ancestors; an integration in two siblings counts twice above them."""
    own = counts.join(membership, "integration").groupBy("category").agg(F.sum("count").alias("count"))
    return own.join(tree.select(F.col("descendant").alias("category"), "ancestor"), "category").groupBy("ancestor").agg(F.sum("count").cast("long").alias("count")).select(F.col("ancestor").alias("category"), "count")
