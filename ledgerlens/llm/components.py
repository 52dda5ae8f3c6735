"""Connected components of an undirected graph given as edges, by repeated joins (smallest label, with pointer jumping)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the edges ``a, b`` (longs): the label is the smallest node of its component.

    Every round is written to the shared folder, which cuts lineage, and costs joins of small rows.  Labels spread over
    twice the distance each round, so rounds grow with the logarithm of a component's diameter.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "components")
    # Both directions of an edge from one pass over the edges, which may be costly to make.
    sides = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.where("a <> b").select(F.inline(sides)).distinct()
    both.write.parquet(f"{root}/edges")
    both = spark.read.parquet(f"{root}/edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
    k = 0
    while True:
        labels.write.parquet(f"{root}/{k}")
        labels = spark.read.parquet(f"{root}/{k}")
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = lower.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        after = jump.select("node", F.least("label", "further").alias("label"), "old")
        after.write.parquet(f"{root}/{k}-next")
        after = spark.read.parquet(f"{root}/{k}-next")
        if after.where("label <> old").isEmpty():
            return labels
        labels, k = after.select("node", "label"), k + 1
