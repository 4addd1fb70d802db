"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, label): the smallest node that is reachable, for every node of the undirected links (a, b).

    Rounds of taking the least label among the neighbours, then the label's
    label, until no label changes.  Each round is written, so a lost executor
    costs one round; nothing but a count reaches the driver.  The labels are a
    table of `steps`, those of earlier rounds are dropped.
    """
    both = steps.written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    held = steps.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    labels = held
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        moved = steps.written(best.join(jump, best["label"] == jump["via"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        steps.drop(held)
        held, labels = moved, moved.select("node", "label")
        if not moved.filter("old <> label").limit(1).count():
            steps.drop(both)
            return held
