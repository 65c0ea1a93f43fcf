"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylomill.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (x, y): the smallest node that it is linked with, directly or not.

    Each round takes the smallest label among the neighbours and then the label's own label, so a chain's length halves.
    """
    both = cut(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["x"]).select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        new = cut(lower.join(up, "low").select("node", F.least("low", "jump").alias("next"), "label"))
        moved = new.where("next < label").limit(1).count()
        labels = new.select("node", F.col("next").alias("label"))
        if not moved:
            return labels
