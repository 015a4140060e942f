"""Positions in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.session import cut


def dense_index(values: DataFrame, column: str, name: str) -> DataFrame:
    """``values`` with ``name``: the position (from 0) of each row in the order of ``column``.

    The rows are range-sorted and written once; the partitions' sizes (one row
    per partition) are summed up, and a row's position is its place in its
    partition after the sizes before.
    """
    placed = cut(values.sort(column).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.select("*", F.shiftright("_at", 33).alias("_part"))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")).drop("_at", "_part", "_before")
