"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(v, c) for every end of links (a, b): c is the smallest v reachable.

    Every round takes the smallest label among the neighbours, then the label of that label; rounds end when nothing
    changes. Links of a hub are summed up within their tasks before the shuffle.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("c")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("c").alias("near"))
        step = labels.join(near, labels["v"] == near["a"]).select("v", F.least("c", "near").alias("c"), F.col("c").alias("was"))
        step = stored(step, "labels")
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("far"))
        new = stored(step.join(jump, "c").select("v", F.least("c", "far").alias("c"), (F.least("c", "far") != F.col("was")).alias("moved")), "labels")
        labels = new.select("v", "c")
        if new.where("moved").isEmpty():
            return labels
