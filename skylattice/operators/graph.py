"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spill


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (u, v) is connected with.

    Labels spread to neighbours and then jump to the label of their label, so long
    chains shorten by half each round; every round is spilled.  Stops when no label changes.
    """
    both = spill(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    label = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
    label = spill(label)
    for _ in range(most_rounds):
        near = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("root").alias("near")).withColumnRenamed("u", "node")
        step = label.join(near, "node").select("node", F.least("root", "near").alias("next"), "root")
        jump = label.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = spill(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), (F.least("next", F.coalesce("far", "next")) != F.col("root")).alias("changed")))
        label = new.select("node", "root")
        if not new.where("changed").head(1):
            return label
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
