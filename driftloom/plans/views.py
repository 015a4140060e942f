"""Graph sequences and feature series derived from the general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.operators.graphs import clustering, counts
from driftloom.session import cut
from driftloom.sources.tables import table

N_NATIONS = 25


def trade_graphs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Monthly trade between nations: an edge where a pair's line items are at least the month's mean over its pairs."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    buyers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a"))
    sellers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b"))
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    # Line items shrink to (order, seller nation) counts before they meet the orders.
    sold = items.join(sellers, "l_suppkey").groupBy("l_orderkey", "b").agg(F.count(F.lit(1)).alias("w"))
    pairs = orders.join(buyers, "o_custkey").join(sold, F.col("o_orderkey") == F.col("l_orderkey")).filter("a <> b")
    pairs = pairs.groupBy(month.cast("int").alias("t"), F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w"))
    pairs = cut(pairs)  # at most a row per month and pair of nations; snapshots, edges and features all start from it
    of_month = W.partitionBy("t")
    kept = pairs.withColumns({"all": F.sum("w").over(of_month), "pairs": F.count(F.lit(1)).over(of_month)}).filter("w * pairs >= all")
    edges = kept.select(F.lit("trade").alias("series_id"), "t", "u", "v")
    snapshots = pairs.select("t").distinct().select(F.lit("trade").alias("series_id"), "t", F.lit(N_NATIONS).alias("n"))
    return snapshots, edges


def trade_features(spark: SparkSession, folder: str) -> DataFrame:
    """Edges and triangles of each month."""
    snapshots, edges = trade_graphs(spark, folder)
    m = counts(snapshots, edges).select("series_id", "t", "m")
    c = clustering(snapshots, edges).select("series_id", "t", "triangles")
    return m.join(c, ["series_id", "t"]).select("series_id", "t", F.array(F.col("m").cast("double"), F.col("triangles").cast("double")).alias("x"))


KINDS = ("click", "error", "purchase", "signup", "view")


def event_features(spark: SparkSession, folder: str, shift_at: int | None = None, shift: int = 20, minutes: int = 60) -> DataFrame:
    """Counts per kind of event and so many minutes, 0 where there are none, optionally raised by ``shift`` from step ``shift_at`` on."""
    events = table(spark, folder, "events").select("ts", "event_type")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    step = F.floor((F.datediff(F.col("ts"), start) * 1440 + F.hour("ts") * 60 + F.minute("ts")) / F.lit(minutes)).cast("int").alias("t")
    per_hour = events.groupBy(step).agg(*[F.count(F.when(F.col("event_type") == k, 1)).cast("double").alias(k) for k in KINDS])
    spine = per_hour.agg(F.max("t").alias("last")).select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("t"))
    lift = F.when(F.col("t") >= shift_at, float(shift)).otherwise(0.0) if shift_at is not None else F.lit(0.0)
    dense = spine.join(per_hour, "t", "left")
    return dense.select(F.lit("events").alias("series_id"), "t", F.array(*[F.coalesce(F.col(k), F.lit(0.0)) + lift for k in KINDS]).alias("x"))
