"""Connected components of a graph given as staged tables; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _step(both: DataFrame, label: DataFrame) -> DataFrame:
    """Smallest label among neighbours, then one jump along labels; ``old`` is kept."""
    near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
    step = label.join(near, label["node"] == near["a"]).select("node", "old", F.least("root", "near").alias("root"))
    up = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
    return step.join(up, "root").select("node", F.least("root", "up").alias("root"), "old")


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the smallest node of the component.

    Each round hands every node the smallest label among its neighbours and then
    jumps along labels, so paths shorten by half; two rounds are one staged table.
    Labels only fall, so rounds end; how many it takes is up to the graph.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    label = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "cc-label")
    while True:
        now = _step(both, _step(both, label.select("node", "root", F.col("root").alias("old"))))
        now = stage(now.select("node", "root", (F.col("root") < F.col("old")).alias("moved")), "cc-label")
        moved = now.where("moved").limit(1).count()
        discard(label)
        label = now.select("node", "root")
        if not moved:
            discard(both)
            return label
