"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of each node of ``a, b`` edges; root is the component's smallest node.

    Each round takes the least label among a node's neighbours and then its label's label, so that
    paths halve. Labels are written to the shared folder, which cuts the lineage. Nodes with very
    many neighbours only meet as grouped minima and as the many side of a join, which Spark splits.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        least = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("root", "m").alias("next"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("root").alias("jump"))
        new = least.join(jump, F.col("next") == F.col("j_node"), "left")
        new = stored(new.select("node", F.least("next", "jump").alias("root"), "old"), "labels")
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
