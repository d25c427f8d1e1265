"""Connected components by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.llm._common import drop_path, hot_join, hot_keys, new_path, staged


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges(a, b)``; the component is its
    least node.

    Each round takes the least label among a node's neighbours and then that
    label's own label, which halves the depth; it ends when no label moves. A
    node with a large share of the edges, and a label with a large share of the
    nodes, are looked up by broadcast (fewer than 1000 rows, see ``hot_join``), so
    neither meets in one task; minima are combined before the shuffle. Labels are
    written to the shared folder after each round. No edges: no rows. Loops and
    repeated edges change nothing; edges with a null end are left out."""
    spark = edges.sparkSession
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    paths = [new_path(spark, "edges"), new_path(spark, "labels")]
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct().select(F.col("a"), F.col("b").alias("node")), "edges", paths[0])
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("node")).alias("label")).withColumnRenamed("a", "node"), "labels", paths[1])
    if labels.isEmpty():
        return labels.withColumnRenamed("label", "component")
    hubs = hot_keys(both, "node")
    while True:
        least = hot_join(both, labels, "node", hot=hubs).groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        paths.append(new_path(spark, "near"))
        near = staged(labels.join(least, "node").select("node", F.least("label", "near").alias("near"), "label"), "near", paths[-1])
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        step = hot_join(near, jump, "near").select("node", F.least("near", "far").alias("label"), (F.least("near", "far") != F.col("label")).alias("moved"))
        paths.append(new_path(spark, "labels"))
        made = staged(step, "labels", paths[-1])
        done = made.where("moved").isEmpty()
        labels = made.select("node", "label")
        for old in paths[1:-1] if not done else paths[:-1]:
            drop_path(spark, old)
        paths = [paths[0], paths[-1]]
        if done:
            return labels.withColumnRenamed("label", "component")
