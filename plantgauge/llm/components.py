"""Connected components by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantgauge.llm.common import stored


def components(edges: DataFrame, left: str = "a", right: str = "b", start: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node of each component, for every node that has
    an edge. ``start`` holds labels of a part of the edges, if known. In each round
    a label becomes the smallest of itself, its neighbours' and its own label's
    label, until none changes; every round is one written table."""
    both = edges.select(F.col(left).alias("x"), F.col(right).alias("y"))
    both = stored(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "edges")
    nodes = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("least")).select("node", F.least("node", "least").alias("label"))
    if start is not None:
        known = start.select(F.col("node").alias("seen"), F.col("label").alias("before"))
        nodes = nodes.join(known, nodes.node == known.seen, "left").select("node", F.least("label", F.coalesce("before", "label")).alias("label"))
    labels = stored(nodes, "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("top"))
        new = (
            labels.join(near, labels.node == near.x)
            .join(jump, F.col("label") == F.col("at"), "left")
            .select("node", F.least("label", "near", F.coalesce("top", "label")).alias("label"), F.col("label").alias("old"))
        )
        new = stored(new, "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
