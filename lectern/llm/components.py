"""Connected components by minimum labels with pointer jumping, as Spark joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

ROUNDS = 60  # jumping halves the depth of label chains each round, so this is never reached in practice


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node of its component."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        moved = own.join(jump, F.col("new") == F.col("via"), "left").select("node", "label", F.least("new", F.coalesce("further", "new")).alias("new"))
        moved = stored(moved, "labels")
        changed = moved.where("new < label").limit(1).count()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("labels did not settle")
