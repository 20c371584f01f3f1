"""Transitive closure of a parent-child relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.checkpoints import cut


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """All (ancestor, descendant, depth) pairs; depth is the shortest distance.

    Paths double: with all pairs up to distance r known, those up to 2r are pairs at distance r exactly, joined with all
    pairs that go on from there. A shortest path passes a node at distance r, so none is missed, and the rounds grow with
    the logarithm of the depth. Every round is checkpointed, so the plan does not grow with it. A cycle adds no pair that
    isn't known, so the rounds end there too.
    """
    steps = edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(
        F.col(parent).alias("ancestor"), F.col(child).alias("descendant")).distinct()
    found = cut(steps.withColumn("depth", F.lit(1).cast("bigint")))
    reach = 1
    while True:
        far = found.where(F.col("depth") == reach)
        if far.isEmpty():
            return found
        onward = found.select(F.col("ancestor").alias("middle"), F.col("descendant").alias("end"), F.col("depth").alias("more"))
        reached = (
            far.join(onward, F.col("descendant") == F.col("middle"))
            .groupBy("ancestor", F.col("end").alias("descendant")).agg((F.min("more") + reach).alias("depth"))
        )
        found = cut(found.unionByName(reached.join(found, ["ancestor", "descendant"], "left_anti")))
        reach *= 2
