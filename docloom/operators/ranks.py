"""Running sums and ranks over groups of any size: sorted by ranges, then summed in two steps.

A group may be all rows: each task sums up what it has of it, a row for each task and group is summed up
again, and nothing else of a group meets in one place.

Nulls and ties: null keys come first and are equal; rows of equal keys are in any order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_dir


def staged(rows: DataFrame, name: str) -> DataFrame:
    """Rows written into the shared folder and read again: their places in tasks are then fixed."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def running_sums(rows: DataFrame, groups: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """``rows`` with ``sum_before``, the weights (1 without) of the rows before in the same group by ``order``, and ``sum_all`` of the group."""
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    keys = [F.col(c).asc_nulls_first() for c in [*groups, *order]]
    group = F.to_json(F.struct(F.lit(0).alias("g"), *groups))
    ranged = rows.withColumn("_w", w).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = staged(ranged.withColumn("_g", group).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    so_far = Window.partitionBy("_g").orderBy("_part")
    parts = placed.groupBy("_g", "_part").agg(F.sum("_w").alias("m"))
    parts = parts.select("_g", "_part", (F.sum("m").over(so_far) - F.col("m")).alias("_shift"), F.sum("m").over(Window.partitionBy("_g")).alias("sum_all"))
    inside = Window.partitionBy("_g", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("_in", F.sum("_w").over(inside) - F.col("_w")).join(parts, ["_g", "_part"])
    return out.withColumn("sum_before", F.col("_in") + F.col("_shift")).drop("_g", "_part", "_at", "_w", "_in", "_shift")


def nearest_ranks(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank of each group (null values aside), and ``n``: equal values are counted before anything is sorted."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_m"))
    sums = running_sums(counts, by, [value], "_m")
    upto = F.col("sum_before") + F.col("_m")
    # the share's rank is at least 1; it is held against exact numbers, as 0.95 * 20 is over 19 in floating point
    at = lambda p: F.min(F.when(upto >= F.greatest(F.ceil(F.round(F.col("sum_all") * F.lit(p), 9)), F.lit(1)), F.col(value)))
    found = sums.groupBy(*by).agg(*(at(p).alias(name) for name, p in shares.items()))
    total = rows.groupBy(*by).agg(F.count("*").alias("n"))
    same = F.lit(True)
    for c in by:
        same = same & total[c].eqNullSafe(found[c])
    return total.join(found, same, "left").select(*(total[c] for c in by), *shares, "n")
