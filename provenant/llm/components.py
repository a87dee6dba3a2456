"""Connected components over a table of links, by distributed label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import materialise


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of ``links(a, b)``; root is the smallest node reachable.

    Each round takes the least label among a node's neighbours and then jumps
    to that label's own label, so rounds grow with the log of the longest
    chain. Every round is written to the shared folder; the driver only sees
    the number of labels that changed. Hot nodes are summed on the map side
    before their shuffle, and the joins are plain so that skewed ones split.
    No links give no rows.
    """
    links = materialise(links.select("a", "b").where("a != b").distinct(), f"{name}-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), name)
    while True:
        # least label around each node, its own included
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = materialise(labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next")), name)
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = materialise(step.join(jump, "next").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("moved")), name)
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "root")
        if not moved:
            return labels
