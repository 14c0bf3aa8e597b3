"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rainloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """v, label: the smallest vertex of each vertex's component, for edges (a, b) of longs.

    Labels spread to neighbours and then jump to the label of the label, so rounds grow with the logarithm of
    the longest path. Each round is written to the shared folder, which cuts lineage; only a count reaches the driver.
    """
    e = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut_lineage(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("_near"))
        new = labels.join(near, "v").select("v", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("_jump"))
        new = cut_lineage(new.join(jump, "label").select("v", "_old", F.least("label", "_jump").alias("label")))
        if new.where("label <> _old").limit(1).count() == 0:
            return new.select("v", "label")
        labels = new.select("v", "label")
