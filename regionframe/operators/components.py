"""Connected components of a graph of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.sources.cut import cut


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node that edges (src, dst) lead to. Labels sink along edges and jump to their label's label,
    so rounds grow with the logarithm of the longest path; each round is cut from the lineage of those before."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        sunk = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = cut(sunk.join(up, "label").select("node", "was", F.least("label", "above").alias("label")))
        labels = new.select("node", "label")
        if not new.where("was <> label").head(1):
            return labels
