"""The next snapshot's edges, forecast from a window of snapshots.

Each pair of nodes weighs as the sum of ``alpha ** age`` over the window's
snapshots that have it; the heaviest pairs are kept, as many as the window's
mean density asks for. Everything is a join of edges with the later steps whose
window they are in, an aggregation per pair, and a rank per step.

Mixing the weights with their own projection onto the kept pairs, as is
sometimes done, lifts those same pairs further and so keeps the same set: no
state has to be carried between steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.operators.graphs import DEFAULT, Feature, canonical_edges, extract


@dataclass(frozen=True)
class GraphForecast:
    """Decay of older snapshots, and number of snapshots looked at."""

    alpha: float = 0.5
    window: int = 20

    def __post_init__(self) -> None:
        if not 0.0 < self.alpha < 1.0:
            raise ValueError("alpha must lie strictly between 0 and 1")
        if self.window < 1:
            raise ValueError("window must be positive")


def _weights(e: DataFrame, spec: GraphForecast) -> DataFrame:
    """``series_id, t, u, v, weight`` of every pair that a snapshot of the window up to t has."""
    ages = F.explode(F.sequence(F.lit(0), F.lit(spec.window - 1))).alias("age")
    spread = e.select("series_id", F.col("t").alias("at"), "u", "v", ages)
    spread = spread.select("series_id", (F.col("at") + F.col("age")).alias("t"), "u", "v", F.pow(F.lit(spec.alpha), F.col("age") + 1).alias("w"))
    return spread.groupBy("series_id", "t", "u", "v").agg(F.sum("w").alias("weight"))


def forecast_edges(snapshots: DataFrame, edges: DataFrame, spec: GraphForecast) -> DataFrame:
    """``series_id, t, u, v``: the edges forecast at step t from the steps t - window + 1 .. t.

    Steps count by t. Ties in weight go to the smaller (u, v). Steps whose
    window isn't full yet have no forecast.
    """
    e = canonical_edges(edges)
    steps = snapshots.groupBy("series_id").agg(F.min("t").alias("first"))
    weights = _weights(e, spec)

    m = e.groupBy("series_id", "t").agg(F.count(F.lit(1)).alias("m"))
    pairs = F.col("n").cast("bigint") * (F.col("n") - 1) / 2
    over = W.partitionBy("series_id").orderBy("t").rangeBetween(-(spec.window - 1), 0)
    sizes = snapshots.join(m, ["series_id", "t"], "left").withColumn("density", F.when(pairs > 0, F.coalesce("m", F.lit(0)) / F.when(pairs > 0, pairs)).otherwise(0.0))
    # Half is rounded to even.
    sizes = sizes.select("series_id", "t", F.bround(F.round(F.avg("density").over(over) * pairs, 9)).cast("int").alias("target"))
    sizes = sizes.join(steps, "series_id").filter(F.col("t") - F.col("first") >= spec.window - 1)
    order = W.partitionBy("series_id", "t").orderBy(F.desc(F.round("weight", 12)), "u", "v")
    ranked = weights.join(sizes, ["series_id", "t"]).withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= F.col("target")).select("series_id", "t", "u", "v")


def forecast_features(snapshots: DataFrame, edges: DataFrame, spec: GraphForecast, features: tuple[Feature, ...] = DEFAULT) -> DataFrame:
    """``series_id, t, x``: features of the forecast graph, to be given to ``detect`` as ``ahead``."""
    first = snapshots.groupBy("series_id").agg(F.min("t").alias("first"))
    late = snapshots.join(first, "series_id").filter(F.col("t") - F.col("first") >= spec.window - 1).drop("first")
    return extract(late, forecast_edges(snapshots, edges, spec), features)


def diagnostics(snapshots: DataFrame, edges: DataFrame, spec: GraphForecast) -> DataFrame:
    """``series_id, t, degree_gap, sparsity_gap``: how far the forecast at t is from the window.

    ``degree_gap`` is the mean squared z-score of the forecast's degrees against
    each node's degrees in the window (nodes whose degree didn't vary count by
    the plain squared difference); ``sparsity_gap`` is the difference in density.
    """
    n = snapshots.select("series_id", "t", "n")
    nodes = n.select("series_id", "t", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)))).alias("x"), "n").filter("x < n")
    degree = lambda e: e.select("series_id", "t", F.explode(F.array("u", "v")).alias("x")).groupBy("series_id", "t", "x").agg(F.count(F.lit(1)).alias("d"))
    forecast = forecast_edges(snapshots, edges, spec)
    seen = nodes.join(degree(canonical_edges(edges)), ["series_id", "t", "x"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    over = W.partitionBy("series_id", "x").orderBy("t").rangeBetween(-(spec.window - 1), 0)
    seen = seen.withColumns({"mean": F.avg("d").over(over), "sd": F.stddev_pop("d").over(over), "first": F.min("t").over(W.partitionBy("series_id"))})
    both = seen.filter(F.col("t") - F.col("first") >= spec.window - 1).join(degree(forecast).withColumnRenamed("d", "df"), ["series_id", "t", "x"], "left")
    z = (F.coalesce("df", F.lit(0)) - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    gaps = both.groupBy("series_id", "t", "n").agg(F.avg(z * z).alias("degree_gap"), (F.sum(F.coalesce("df", F.lit(0))) / 2).alias("mf"), (F.sum("mean") / 2).alias("mw"))
    pairs = F.greatest(F.col("n") * (F.col("n") - 1) / 2, F.lit(1))
    return gaps.select("series_id", "t", "degree_gap", (F.abs(F.col("mf") - F.col("mw")) / pairs).alias("sparsity_gap"))


def blend_state(snapshots: DataFrame, edges: DataFrame, spec: GraphForecast) -> DataFrame:
    """``series_id, t, delta, delta_ema, beta``: how much better the binary forecast fits the last snapshot than the weights do, its moving average, and the blend.

    ``delta`` is the Frobenius distance of the window's normalised weights from
    the last snapshot less that of the forecast; ``beta`` is the weight that the
    average before gives to the weights. The forecast itself doesn't depend on it.
    """
    by = ["series_id", "t"]
    e = canonical_edges(edges)
    first = snapshots.groupBy("series_id").agg(F.min("t").alias("first"))
    total = sum(spec.alpha**j for j in range(1, spec.window + 1))
    seen = e.withColumn("a", F.lit(1.0))
    weighed = _weights(e, spec).withColumn("w", F.col("weight") / F.lit(total)).join(seen, [*by, "u", "v"], "left")
    soft = weighed.groupBy(*by).agg(F.sum(F.col("w") * F.col("w")).alias("ww"), F.sum(F.col("w") * F.coalesce("a", F.lit(0.0))).alias("wa"))
    hard = forecast_edges(snapshots, edges, spec).join(seen, [*by, "u", "v"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("ff"), F.count("a").alias("fa"))
    m = e.groupBy(*by).agg(F.count(F.lit(1)).alias("m"))
    steps = snapshots.join(first, "series_id").filter(F.col("t") - F.col("first") >= spec.window - 1).select(*by)
    for part in (soft, hard, m):
        steps = steps.join(part, by, "left")
    steps = steps.fillna(0)
    gap = lambda own, both: F.sqrt(F.greatest(2.0 * (F.col(own) - 2.0 * F.col(both) + F.col("m")), F.lit(0.0)))
    steps = steps.select(*by, (gap("ww", "wa") - gap("ff", "fa")).alias("delta"))
    # A number per step and series: the average is a fold over them.
    series = steps.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "delta"))).alias("s"))
    fold = F.aggregate(
        "s",
        F.array().cast("array<struct<t:int,delta:double,delta_ema:double,before:double>>"),
        lambda out, x: F.concat(
            out,
            F.array(
                F.struct(
                    x["t"].cast("int").alias("t"),
                    x["delta"].alias("delta"),
                    (F.lit(spec.alpha) * x["delta"] + F.lit(1.0 - spec.alpha) * F.coalesce(F.try_element_at(out, F.lit(-1))["delta_ema"], F.lit(0.0))).alias("delta_ema"),
                    F.coalesce(F.try_element_at(out, F.lit(-1))["delta_ema"], F.lit(0.0)).alias("before"),
                )
            ),
        ),
    )
    rows = series.select("series_id", F.inline(fold))
    return rows.select("series_id", "t", "delta", "delta_ema", (1.0 / (1.0 + F.exp("before"))).alias("beta"))
