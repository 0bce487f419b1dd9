"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the smallest node of the component.

    Each round every node hooks onto its smallest neighbour, trees are flattened
    by pointer jumping, and the edges are contracted to the roots; at least half
    of the touched nodes vanish per round.  All tables stay distributed."""
    spark = edges.sparkSession
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    labels = spark.createDataFrame([], f"node {edges.schema['a'].dataType.simpleString()}, root {edges.schema['a'].dataType.simpleString()}")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p"))
                        .select("node", F.least("node", "p").alias("parent")), "cc-parent")
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            moved = stored(parent.join(up, "parent").select("node", F.col("next").alias("parent"),
                                                            (F.col("next") != F.col("parent")).alias("moved")), "cc-parent")
            parent = moved.select("node", "parent")
            if moved.where("moved").isEmpty():
                break
        known = labels.join(parent.select(F.col("node").alias("root"), "parent"), "root", "left").select(
            "node", F.coalesce("parent", "root").alias("root"))
        fresh = parent.join(labels.select("node"), "node", "left_anti").select("node", F.col("parent").alias("root"))
        labels = stored(known.unionByName(fresh), "cc-labels")
        edges = stored(
            edges.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
            .join(parent.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct(), "cc-edges")
    return labels
