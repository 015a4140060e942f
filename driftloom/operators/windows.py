"""Ordered analytics per series as window expressions: centroids, scores, p-values, forecasts, moments, martingales.

Every function takes a long table ``series_id, t, k, x`` (one row per series,
step and feature) and adds columns to it. One exchange on (series_id, k) serves
them all; only ranks among all earlier scores leave the window form, for arrays.
A step without a past gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.betting import LOG_FLOOR, Bet, default, log_bet
from driftloom.functions.theta import theta
from driftloom.operators.detector import ranks
from driftloom.operators.series import STACK


def _series() -> W:
    return W.partitionBy("series_id", "k").orderBy("t")


def _before() -> W:
    return _series().rowsBetween(W.unboundedPreceding, -1)


def to_long(features: DataFrame) -> DataFrame:
    """``series_id, t, k, x`` from ``series_id, t, x ARRAY``."""
    return features.select("series_id", "t", F.posexplode("x").alias("k", "x"))


def centroids(rows: DataFrame) -> DataFrame:
    """``c``: the mean of the steps before; ``c_now``: the mean up to and including this step."""
    return rows.withColumns({"c": F.avg("x").over(_before()), "c_now": F.avg("x").over(_series().rowsBetween(W.unboundedPreceding, 0))})


def nonconformity(rows: DataFrame) -> DataFrame:
    """``s``: distance from the centroid of the steps before, 0 at the first step."""
    return rows.withColumn("s", F.coalesce(F.abs(F.col("x") - F.avg("x").over(_before())), F.lit(0.0)))


def _with_ranks(rows: DataFrame, point: str) -> DataFrame:
    """``rows`` with ``_above, _equal, _before``: how many of the scores ``s`` before are above and equal to ``point``, and how many there are.

    Each (series, feature) is gathered once, as arrays of its steps; ranks of
    series of one length are computed together, in T log T.
    """
    rest = [c for c in rows.columns if c not in ("series_id", "k")]
    steps = F.array_sort(F.collect_list(F.struct("t", *[c for c in rest if c != "t"])))
    series = rows.groupBy("series_id", "k").agg(steps.alias("steps"))
    kinds = {f.name: f for f in rows.schema.fields}
    names = ["t", *[c for c in rest if c != "t"]]
    schema = T.StructType([kinds[c] for c in ("series_id", "k", *names)] + [T.StructField(c, T.LongType()) for c in ("_above", "_equal", "_before")])
    at_s, at_point = names.index("s"), names.index(point)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            columns = pc.list_flatten(batch.column(2)).flatten()
            s, now = (columns[i].to_numpy(zero_copy_only=False).astype(np.float64) for i in (at_s, at_point))
            above, equal = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
            for length in np.unique(lengths):
                alike = np.flatnonzero(lengths == length)
                most = max(1, STACK // max(int(length), 1))
                for low in range(0, len(alike), most):
                    place = starts[alike[low : low + most]][:, None] + np.arange(length)[None, :]
                    above[place], equal[place] = ranks(s[place], now[place], 0)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), lengths))
            before = pa.array(np.arange(len(s)) - np.repeat(starts, lengths))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(1).take(owner), *columns, pa.array(above), pa.array(equal), before],
                names=["series_id", "k", *names, "_above", "_equal", "_before"],
            )

    return series.mapInArrow(run, schema)


def conformal_pvalues(rows: DataFrame, seed: int = 0) -> DataFrame:
    """``p``: smoothed rank of ``s`` among the scores before; null at the first step.

    p = (number above + theta * (1 + number equal)) / (number before + 1).
    """
    ranked = _with_ranks(rows, "s")
    p = (F.col("_above") + theta(seed, F.col("series_id"), F.col("t"), F.col("k")) * (1 + F.col("_equal"))) / (F.col("_before") + 1)
    return ranked.withColumn("p", F.when(F.col("_before") > 0, p)).drop("_above", "_equal", "_before")


def predictive_pvalues(rows: DataFrame, score: str = "s_ahead") -> DataFrame:
    """``p_ahead``: rank of a forecast's score among the observed scores before, without smoothing; 1 at the first step."""
    ranked = _with_ranks(rows, score)
    return ranked.withColumn("p_ahead", (F.col("_above") + F.col("_equal") + 1) / (F.col("_before") + 1)).drop("_above", "_equal", "_before")


def ewma_forecast(rows: DataFrame, alpha: float = 0.5, window: int = 20) -> DataFrame:
    """``forecast``: weighted mean of the last ``window`` steps, weights falling by the factor ``alpha``."""
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie strictly between 0 and 1")
    recent = F.collect_list("x").over(_series().rowsBetween(-(window - 1), 0))
    start = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    # Oldest first: each step shrinks what was gathered by alpha and adds itself with weight 1.
    fold = F.aggregate(
        recent,
        start,
        lambda a, x: F.struct((a["num"] * F.lit(alpha) + x).alias("num"), (a["den"] * F.lit(alpha) + F.lit(1.0)).alias("den")),
        lambda a: a["num"] / a["den"],
    )
    return rows.withColumn("forecast", fold)


def holt_forecast(rows: DataFrame, horizon: int, alpha: float = 0.3, beta: float = 0.1, window: int = 20) -> DataFrame:
    """``forecast``: level + horizon * trend of a double exponential smoothing of the last ``window`` steps.

    Level and trend start as the first value and the first difference, and every
    value from the second on updates them. A single step forecasts itself.
    """
    recent = F.collect_list("x").over(_series().rowsBetween(-(window - 1), 0))
    start = F.struct(F.get(recent, F.lit(0)).alias("level"), (F.get(recent, F.lit(1)) - F.get(recent, F.lit(0))).alias("trend"))

    def step(a: Column, x: Column) -> Column:
        level = F.lit(alpha) * x + F.lit(1.0 - alpha) * (a["level"] + a["trend"])
        return F.struct(level.alias("level"), (F.lit(beta) * (level - a["level"]) + F.lit(1.0 - beta) * a["trend"]).alias("trend"))

    fold = F.aggregate(F.slice(recent, 2, window), start, step, lambda a: a["level"] + F.lit(float(horizon)) * a["trend"])
    return rows.withColumn("forecast", F.when(F.size(recent) < 2, F.col("x")).otherwise(fold))


def running_moments(rows: DataFrame) -> DataFrame:
    """``mean`` and ``sd`` (with one degree of freedom less) of the steps before; null while undefined."""
    before = F.count(F.lit(1)).over(_before())
    return rows.withColumns({"mean": F.avg("x").over(_before()), "sd": F.when(before > 1, F.stddev_samp("x").over(_before()))})


def normalise(rows: DataFrame, startup: int) -> DataFrame:
    """``x`` less its mean over the first ``startup`` steps, divided by their standard deviation (1 if that is next to 0).

    With fewer than 5 steps to go by, ``x`` is left as it is.
    """
    if startup < 5:
        return rows
    whole = W.partitionBy("series_id", "k").orderBy("t").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.when(F.col("t") < startup, F.col("x"))
    sd = F.coalesce(F.stddev_samp(first).over(whole), F.lit(0.0))
    return rows.withColumn("x", (F.col("x") - F.avg(first).over(whole)) / F.when(sd < 1e-10, F.lit(1.0)).otherwise(sd))


def log_martingale(rows: DataFrame, bet: Bet | None = None, p: str = "p") -> DataFrame:
    """``logm``: the running log wealth of betting on ``p``, from 0 at the first step and never below the floor.

    The clamped sum L[t] = max(L[t-1] + y[t], floor) is a Lindley recursion; with
    Y the plain running sum it equals Y[t] + max(0, max over s <= t of floor - Y[s]),
    two window functions instead of a fold. A null p changes nothing.
    """
    y = F.when(F.row_number().over(_series()) == 1, 0.0).otherwise(F.coalesce(log_bet((bet or default())(F.col(p))), F.lit(0.0)))
    upto = _series().rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_y", y).withColumn("_sum", F.sum("_y").over(upto))
    lift = F.max(F.lit(LOG_FLOOR) - F.col("_sum")).over(upto)
    return out.withColumn("logm", F.col("_sum") + F.greatest(F.lit(0.0), lift)).drop("_y", "_sum")


def sum_martingale(rows: DataFrame) -> DataFrame:
    """``series_id, t, logm, total``: the features' log wealth in order, and the log of the summed wealth."""
    from driftloom.functions.betting import log_sum_exp

    parts = rows.groupBy("series_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "logm"))), lambda s: s["logm"]).alias("logm"))
    return parts.withColumn("total", log_sum_exp(F.col("logm")))
