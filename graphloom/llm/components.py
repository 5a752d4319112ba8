"""Connected components of an undirected graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Labels go to the smallest neighbouring label and are then looked up once more (pointer jumping),
    so rounds grow with the logarithm of the longest path; each round is a written table.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.put(both, "edges")
    labels = scratch.put(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("component").alias("far"))
        new = scratch.put(moved.join(jump, "step", "left").select("node", "old", F.least("step", F.coalesce("far", "step")).alias("component")), "labels")
        done = new.filter(F.col("old") != F.col("component")).isEmpty()
        scratch.drop(labels)
        scratch.settle()
        labels = new
        if done:
            scratch.drop(both)
            return labels.select("node", "component")
