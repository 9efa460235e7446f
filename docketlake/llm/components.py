"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.store import saved


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` for every linked node; the component is its smallest node.

    Each round links every label to its smallest neighbouring label and rewrites the
    labels, so the links left between different labels shrink to none.  Hot nodes only
    meet partial minima (``groupBy().min``), never a list of their neighbours.
    """
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a != b")
    edges = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        left_label = labels.select(F.col("node").alias("a"), F.col("component").alias("from_label"))
        right_label = labels.select(F.col("node").alias("b"), F.col("component").alias("to_label"))
        hooks = saved(
            edges.join(left_label, "a").join(right_label, "b").where("from_label > to_label")
            .groupBy("from_label").agg(F.min("to_label").alias("to_label")), "hooks")
        if hooks.isEmpty():
            return labels
        # A hook may point to a label that is hooked itself: follow one more step.
        further = hooks.select(F.col("from_label").alias("to_label"), F.col("to_label").alias("next_label"))
        hooks = hooks.join(further, "to_label", "left").select(
            F.col("from_label").alias("component"), F.coalesce("next_label", "to_label").alias("new_label"))
        labels = saved(labels.join(hooks, "component", "left").select(
            "node", F.coalesce("new_label", "component").alias("component")), "labels")
