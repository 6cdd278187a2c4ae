"""Connected components over an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapath.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges (a, b)``; nodes of one component share the label (its smallest node).

    Each round takes the smallest label among the neighbours and then the label of
    the label, so a label travels twice as far in every round.  A round is written to the
    shared checkpoint folder; nothing but a count reaches the driver.
    """
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, labels.node == heard.a).select("node", F.least("label", "heard").alias("label"))
        nearer = keep(nearer)
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = keep(nearer.join(jump, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            return labels
