"""Connected components of a graph given as a table of edges."""

from pyspark.sql import functions as F

from fieldspark.storage import cut_lineage


def components(edges, a="a", b="b"):
    """``node, label`` for every node of ``edges``: the smallest node it can reach.

    Each round takes the smallest label among a node's neighbours, then the label of
    that label; labels are written to the checkpoint folder between rounds, so a
    lost executor costs one round. Only a count of changes comes to the driver. A
    hub's edges are spread: the neighbour's label is joined to the edges, and the
    smallest is taken in part before the shuffle.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = both.union(both.select("other", "node")).where("node <> other").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), "label"), "other")
            .groupBy("node")
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", "label", F.least("label", "near").alias("low")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        step = cut_lineage(
            lower.join(jump, "low").select(
                "node", "label", F.least("low", "further").alias("next")
            )
        )
        labels = step.select("node", F.col("next").alias("label"))
        if not step.where("label <> next").limit(1).count():
            return labels
