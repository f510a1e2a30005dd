"""Connected components of a graph of links, as joins on labels: nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import drop, met, written


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, label): label is the smallest node of the component; only nodes with links appear.

    Each round takes the smallest label among a node and its neighbours and then jumps to that label's own label,
    so that the distance to the smallest node at least halves on paths. Null ends are ignored; repeated links do no harm.
    """
    real = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    both = written(real.select("a", "b").union(real.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = written(labels, "labels")
    nodes = labels.count()
    while True:
        near = both.join(met(labels, nodes), both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(met(near, nodes), labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        now = written(least.join(met(up, nodes), F.col("label") == F.col("_n"), "left").select("node", "was", F.least("label", F.coalesce("_l", "label")).alias("label")), "labels")
        changed = now.where(F.col("label") != F.col("was")).limit(1).count()
        drop(labels)
        labels = now.select("node", "label")
        if not changed:
            drop(both)
            return labels
