"""Connected components of a table of links, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.llm.base import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (smallest node reachable) for every node in `links` (a, b), either direction, a and b not null.

    Each round hands the smallest label of its neighbours to every node and then follows labels once
    (a label is itself a node), so chains shrink by doubling. Messages are combined before the shuffle; each
    round is written to the shared folder, so a lost executor costs one round at most.
    """
    both = scratch.write(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        told = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("heard"))
        step = labels.join(told, labels["node"] == told["a"], "left").select(
            "node", F.col("component").alias("before"), F.least("component", F.coalesce("heard", "component")).alias("component")
        )
        step = scratch.write(step, "step")
        jump = step.select(F.col("node").alias("at"), F.col("component").alias("further"))
        after = scratch.write(
            step.join(jump, step["component"] == jump["at"], "left").select(
                "node", "before", F.least("component", F.coalesce("further", "component")).alias("component")
            ),
            "labels",
        )
        labels = after.select("node", "component")
        if not after.where("component <> before").limit(1).count():
            return labels
