"""Connected components by repeated joins; no graph ever leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.operators.skew import attach, hot_counts
from spikeloom.session import checkpoint


def settled(df: DataFrame) -> DataFrame:
    """Checkpointed rows, and nothing left of their lineage.

    Spark removes a shuffle's files once the driver's collector has found that no plan refers to it.
    A driver that only plans collects seldom, so the files of all earlier steps would stay on the
    executors to the end; here the collector is asked after every step.
    """
    out = checkpoint(df)
    jvm = df.sparkSession.sparkContext._jvm
    del df
    jvm.System.gc()
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(u, v)``; label is the least node of its component.

    Each round takes the least label among the neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of the longest path.  Neighbours' labels are reduced
    map-side; a node with very many links is split.  Empty links: no rows.
    """
    ends = links.where(F.col("u") != F.col("v"))
    ends = settled(ends.union(ends.select("v", "u")).distinct())
    first = settled(ends.groupBy("u").agg(F.least("u", F.min("v")).alias("label"), F.count(F.lit(1)).alias("_n")))
    labels = first.select(F.col("u").alias("node"), "label")
    hot = settled(hot_counts(first.select("u", "_n"), ["u"]))  # the links stay, so their hot nodes do
    while True:
        near = attach(ends, labels.select(F.col("node").alias("u"), "label"), ["u"], F.col("v"), hot=hot)
        least = near.groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(least, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        # A large component's label is on many rows: adaptive execution splits such a join.
        step = step.join(jump, "label").select("node", F.least("label", "far").alias("label"), "was")
        step = settled(step)
        moved = step.where(F.col("label") != F.col("was")).count()
        labels = step.select("node", "label")
        if not moved:
            return labels
