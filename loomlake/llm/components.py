"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of ``edges`` with the smallest node it can reach.

    Each round takes the smallest label among the neighbours and then the label of
    that label, so the number of rounds grows with the logarithm of the longest path.
    Both joins are plain equi-joins, which can be split where one node has many edges.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    both = scratch.table(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = scratch.table(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(up, "label", "left").select("node", "old", F.least("label", "further").alias("label"))
        new = scratch.table(step, "labels")
        changed = new.where("label <> old").limit(1).count()
        scratch.drop(labels)
        labels = new.drop("old")
        if not changed:
            scratch.drop(both)
            return labels
