"""Connected components of a table of links, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage_table


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Each round takes the smallest label of the neighbours and then the label of that label, so long
    chains shrink fast.  Labels are written out after each round; only a count comes to the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = stage_table(both, "links")
    labels = stage_table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "l", F.least("l", "near").alias("new"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("l").alias("j_l"))
        moved = lower.join(jump, F.col("new") == F.col("j_node"), "left").select("node", F.coalesce(F.least("new", "j_l"), F.col("new")).alias("l"), (F.least("new", F.coalesce("j_l", "new")) != F.col("l")).alias("changed"))
        moved = stage_table(moved, "labels")
        drop_stage(labels)
        labels = moved.select("node", "l")
        if moved.filter("changed").isEmpty():
            drop_stage(both)
            return labels.select("node", F.col("l").alias("component"))
    raise RuntimeError("components didn't settle")
