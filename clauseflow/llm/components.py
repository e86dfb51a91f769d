"""Connected components of large graphs, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge (a, b: long): label is the least node of its component.

    Each turn hooks a node's parent and the node itself to the least grandparent among its neighbours, then jumps to
    grandparents; turns end when no label changes, after about the logarithm of the longest path. Every step is an
    equi-join on a written table or a minimum that combines before it shuffles; nothing is collected.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = saved(both, "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        grand = saved(labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").select("node", "label", "up"), "up")
        near = both.join(grand.select(F.col("node").alias("b"), F.col("up").alias("least")), "b").groupBy("a").agg(F.min("least").alias("least"))
        seen = grand.join(near.withColumnRenamed("a", "node"), "node")
        hooks = seen.select(F.col("label").alias("node"), "least").unionByName(seen.select("node", "least")).unionByName(grand.select("node", F.col("up").alias("least")))
        fresh = saved(hooks.groupBy("node").agg(F.min("least").alias("label")), "labels")
        changed = not fresh.join(labels.withColumnRenamed("label", "before"), "node").filter("label <> before").isEmpty()
        discard(grand)
        if not changed:
            return fresh
        labels = fresh
