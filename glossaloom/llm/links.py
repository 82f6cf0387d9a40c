"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaloom.llm.batches import written


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node that links (a, b) lead to, for every row of ``nodes`` (node).

    Each round takes the least label around, then the label of the label, so rounds grow with the logarithm of a chain's
    length; every round is a written table.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = written(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while True:
        around = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(around.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component")
        )
        step = written(step, "labels")
        above = step.select(F.col("node").alias("component"), F.col("component").alias("above"))
        label = written(step.join(above, "component").select("node", "before", F.col("above").alias("component")), "labels")
        changed = label.where("before != component").limit(1).count()
        label = label.drop("before")
        if not changed:
            break
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
