"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); component is the smallest node reached.

    Each round takes the smallest label among neighbours and then the label of that label, so chains halve.  Rounds
    end when no label changes, however many that takes; each is written to the shared folder.  Null ends are ignored.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    changed = 1
    while changed:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("least"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = stage(step.join(jump, step.label == jump.at, "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
    return labels.select("node", F.col("label").alias("component"))
