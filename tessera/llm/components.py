"""Connected components of a link table, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import removed_table, written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the smallest node of the component) for every node of ``links`` (a, b: long).

    Each round gives a node the smallest label around it and then that label's own label, so
    labels move by doubling distances; every round is a written table without lineage.
    """
    both = links.select(F.col("a"), F.col("b")).where("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        around = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("near"))
        lower = labels.join(around, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("further"))
        then = lower.join(jump, "new").select("node", "old", F.least("new", "further").alias("component"))
        step, held = written(then, f"{name}-{turn}"), labels
        removed_table(held)  # its successor is a table of its own
        labels = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            removed_table(both)
            return labels
