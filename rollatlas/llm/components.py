"""Connected components of links by contraction, with Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollatlas.llm.shared import stage


def _roots(parents: DataFrame, files: int | None) -> DataFrame:
    """Follow (node, root) pointers to their end; each pass halves the way."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = stage(
            parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")),
            "component-jump", files,
        )
        parents = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return parents


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root) of every node of the (a, b) links: root is the smallest node of its component.

    Every node hooks to its smallest smaller neighbour, pointers are followed to their roots, and
    links between different roots make the next, smaller graph. Each table on the way is written
    as ``files`` files at most.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()

    edges = stage(oriented(links), "component-links", files)
    found = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        hooks = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "component-hooks", files)
        tops = _roots(hooks, files)
        found = stage(
            found.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
            .select("node", F.coalesce("top", "root").alias("root")),
            "component-labels", files,
        )
        one = tops.select(F.col("node").alias("a"), F.col("root").alias("a_root"))
        two = tops.select(F.col("node").alias("b"), F.col("root").alias("b_root"))
        renamed = edges.join(one, "a", "left").join(two, "b", "left")
        edges = stage(
            oriented(renamed.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))),
            "component-links", files,
        )
    return found
