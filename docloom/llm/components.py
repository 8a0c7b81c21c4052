"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged

def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, its smallest id, for all ids in ``edges`` (a, b).

    Edges to all lower neighbours of an id become edges to the lowest of them first, which
    leaves few where groups are dense. Each round takes the smallest label of the neighbours, then the label of the label, so
    the rounds grow with the logarithm of a component's diameter. Only labels and edges are
    moved, and the driver sees a count. Each join reads a staged table on one side that has one
    row for each key, so the rows of a hub or of a large component on the other side are split
    by Spark's handling of skewed joins. Tables of earlier rounds are deleted.
    """
    low = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    star = low.withColumn("c", F.min("a").over(Window.partitionBy("b")))  # all lower neighbours of b are one with the lowest
    fewer = star.select(F.explode(F.array(F.struct(F.col("c").alias("a"), F.col("b").alias("b")), F.struct(F.col("c").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
    both = staged(fewer.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*"), "edges")
    last = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    while True:
        labels = last.select("id", "component")
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        above = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = staged(lower.join(above, "component").select("id", "old", F.least("component", "above").alias("component")), "labels")
        discard(last)
        last = new
        if not new.filter("component <> old").limit(1).count():
            discard(both)
            return new.select("id", "component")
