"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaloom.plans.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node it is linked to) for every node of ``edges(a, b)``, of any sortable type.

    A node takes the least label around it, then the label of that label, so the rounds grow with the logarithm of the
    longest chain.  A node of many edges costs one row per edge; its labels are reduced before they are shuffled.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # The first round needs no join: a node's label is the least of itself and its neighbours.
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        step = label.join(near, "node").select("node", F.col("component").alias("_before"), F.least("component", "_near").alias("component"))
        above = step.select(F.col("node").alias("component"), F.col("component").alias("_above"))
        step = cut(step.join(above, "component").select("node", "_before", F.col("_above").alias("component")))
        label = step.drop("_before")
        if step.where("component <> _before").isEmpty():
            return label
