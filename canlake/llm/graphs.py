"""Connected components of an edge table by Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canlake.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b): the smallest node it is connected with.

    Every round lets each node take the smallest label among its neighbours and then that label's own label, so paths
    shrink fast; rounds end when no label changes. Labels stay in tables; only the number of changes reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = written(stepped.join(of, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("label <> old").limit(1).count():
            return labels.withColumnRenamed("label", "component")
