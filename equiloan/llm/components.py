"""Connected components over an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloan.llm.runtime import stash


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is
    its smallest node. Every round takes the smallest label around each node
    (one join and one partial aggregation) and then the label's own label, so
    the rounds grow with the logarithm of a component's width, and writes the
    labels; a hub is split by the adaptive skew join and its messages are
    combined before they are shuffled."""
    both = stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .filter("a <> b").distinct(), "edges")
    labels = stash(both.groupBy("a").agg(F.min("b").alias("m"))
                   .select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy("a").agg(F.min("component").alias("m")))
        hooked = (labels.join(near, labels["node"] == near["a"])
                  .select("node", F.col("component").alias("old"), F.least("component", "m").alias("component")))
        hooked = stash(hooked, "labels")
        up = hooked.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        jumped = stash(hooked.join(up, F.col("component") == F.col("_n"))
                       .select("node", "old", F.least("component", "_c").alias("component")), "labels")
        labels = jumped.select("node", "component")
        if jumped.filter("component <> old").isEmpty():
            return labels
