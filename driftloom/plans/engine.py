"""Queries for the engine's own operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import betting
from driftloom.functions.attribution import driver, shares, wealth
from driftloom.functions.sql import register
from driftloom.operators import graphs, metrics, windows
from driftloom.operators.charts import Cusum, EwmaChart, control_chart
from driftloom.operators.detector import METRICS, DetectorConfig, Holt, detect, detect_many, detections, joint_scores
from driftloom.operators.graph_forecast import GraphForecast, blend_state, diagnostics, forecast_edges, forecast_features
from driftloom.operators.series import clean_features
from driftloom.plans.detector_sql import default_bet, detector_sql, distance_sql, lse, spread_sql
from driftloom.functions.theta import theta_sql
from driftloom.plans.views import KINDS, event_features, trade_features, trade_graphs
from driftloom.session import cut, own_folder
from driftloom.sources.generators import SCENARIOS, generate
from driftloom.sources.proximity import contact_graphs, read_csv
from driftloom.sources.tables import PEER, USER, table
from driftloom.streaming.online import LAST_PAIR, daily_contacts_stream, detect_stream, run_to_end, sessions_stream, with_end

TRADE = DetectorConfig(threshold=8.0, startup_period=12, history_size=6, cooldown=6)
EVENTS = DetectorConfig(threshold=8.0)
SHIFT_AT = 360
LONG = DetectorConfig(threshold=20.0, startup_period=0, history_size=6)
MATRIX = DetectorConfig(threshold=5.0, startup_period=10, history_size=5, horizon=3, cooldown=5)
DELTA = 4
FORECAST = GraphForecast(alpha=0.5, window=5)


def _graph_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "snapshots"), table(spark, folder, "edges")


def _matrix(spark: SparkSession, folder: str) -> DataFrame:
    return clean_features(table(spark, folder, "feature_matrix"), "computed_at")


def _matrix_long(spark: SparkSession, folder: str) -> DataFrame:
    return windows.to_long(_matrix(spark, folder))


def _rounded(trace: DataFrame, k: int, with_p: bool = True) -> DataFrame:
    """A trace over ``k`` features with a column per feature."""
    at = lambda c, i, digits: F.round(F.get(c, F.lit(i)), digits)
    each = [at(c, i, 6).alias(f"{n}_{i}") for i in range(k) for c, n in (("logm_pf", "logm"), ("logm_pf_h", "logmh"))]
    if with_p:
        each += [at(c, i, 9).alias(f"{c.replace('_', '')}_{i}") for i in range(k) for c in ("p", "p_h")]
    return trace.select("series_id", "t", F.round("logm_trad", 6).alias("logm_trad"), F.round("logm_hrzn", 6).alias("logm_hrzn"), *each, "fired", "fired_by")


# Sources


def proximity_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The contact pairs of each day of the proximity log, over densely numbered users."""
    return contact_graphs(table(spark, folder, "proximity"), threshold=0.3).edges


def proximity_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The same from the log's CSV form, written here for the purpose: a header, ``NA`` for missing values."""
    target = f"{_folder(spark)}/log"
    log = table(spark, folder, "proximity").select(USER, PEER, "time", "prob2")
    log.write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(target, header=True, nullValue="NA")
    return contact_graphs(read_csv(spark, target), threshold=0.3).edges


def proximity_days(spark: SparkSession, folder: str) -> DataFrame:
    """Degree and density of each day's contact graph, empty days too."""
    g = contact_graphs(table(spark, folder, "proximity"))
    return graphs.counts(g.snapshots, g.edges).drop("series_id")


def proximity_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The study's labelled days and the contacts on them."""
    labels = table(spark, folder, "event_labels").select(F.col("day").alias("t"), "label")
    return labels.join(proximity_days(spark, folder).select("t", "m"), "t", "left")


REAL = DetectorConfig(threshold=20.0, normalize_features=True)
SIMPLE = ("mean_degree", "mean_clustering", "density")


def _few(names: tuple[str, ...]) -> tuple[graphs.Feature, ...]:
    return tuple(f for f in graphs.DEFAULT if f.name in names)


def proximity_run(spark: SparkSession, folder: str) -> DataFrame:
    """The whole run over the log: daily graphs of all users, eight features, normalised, detector with threshold 20."""
    g = contact_graphs(table(spark, folder, "proximity"))
    found = detect(graphs.extract(g.snapshots, g.edges), REAL)
    return found.select("t", F.round("logm_trad", 6).alias("logm_trad"), F.round("logm_hrzn", 6).alias("logm_hrzn"), "fired", "fired_by")


def proximity_trace(spark: SparkSession, folder: str) -> DataFrame:
    """The same over the features that counting gives."""
    g = contact_graphs(table(spark, folder, "proximity"))
    return _rounded(detect(_grained(graphs.counted(g.snapshots, g.edges)), REAL), 3)


def trade_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly trade graphs."""
    return trade_graphs(spark, folder)[1]


def matrix_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The feature matrix with one sound row per step."""
    return _matrix(spark, folder).select("series_id", "t", F.posexplode("x").alias("k", "x"))


# Graph features


def graph_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Mean degree and density of every snapshot."""
    return graphs.counts(*_graph_tables(spark, folder))


def graph_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Triangles and mean clustering of every snapshot, by joins."""
    return graphs.clustering(*_graph_tables(spark, folder)).withColumn("mean_clustering", F.round("mean_clustering", 9))


def _features(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    chosen = tuple(f for f in (*graphs.DEFAULT, graphs.Feature("triangle_count", graphs.triangle_count)) if f.name in names)
    x = graphs.extract(*_graph_tables(spark, folder), chosen)
    return x.select("series_id", "t", *[F.round(F.col("x")[i], 9).alias(f.name) for i, f in enumerate(chosen)])


def graph_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Mean betweenness and closeness of every snapshot."""
    return _features(spark, folder, ["mean_betweenness", "mean_closeness"])


def graph_features(spark: SparkSession, folder: str) -> DataFrame:
    """All eight default features of every snapshot."""
    return _features(spark, folder, graphs.names())


def graph_spectrum(spark: SparkSession, folder: str) -> DataFrame:
    """What the spectra must give: sums of powers of eigenvalues, whether the second is above 0, and how far the leading vector is from being one."""
    chosen = tuple(graphs.Feature(f.__name__, f) for f in (graphs.laplacian_sum, graphs.laplacian_squares, graphs.connected, graphs.adjacency_squares, graphs.adjacency_cubes, graphs.leading_residual))
    x = graphs.extract(*_graph_tables(spark, folder), chosen)
    return x.select("series_id", "t", *[(F.round(F.col("x")[i], 6) + 0.0).alias(f.name) for i, f in enumerate(chosen)])


def graph_custom(spark: SparkSession, folder: str) -> DataFrame:
    """A feature of one's own: triangles per node."""
    return _features(spark, folder, ["triangle_count"])


def graph_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The edges forecast from the last snapshots."""
    return forecast_edges(*_graph_tables(spark, folder), FORECAST)


def graph_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """How far the forecast graph is from the window in degrees and density."""
    found = diagnostics(*_graph_tables(spark, folder), FORECAST)
    return found.select("series_id", "t", F.round("degree_gap", 6).alias("degree_gap"), F.round("sparsity_gap", 9).alias("sparsity_gap"))


def graph_blend(spark: SparkSession, folder: str) -> DataFrame:
    """The forecaster's running error and the blend that follows from it."""
    found = blend_state(*_graph_tables(spark, folder), FORECAST)
    return found.select("series_id", "t", *[F.round(c, 8).alias(c) for c in ("delta", "delta_ema", "beta")])


# Ordered analytics over the feature matrix


def conformal(spark: SparkSession, folder: str) -> DataFrame:
    """Centroids, scores and both kinds of p-values."""
    rows = windows.conformal_pvalues(windows.nonconformity(windows.centroids(_matrix_long(spark, folder))))
    rows = windows.ewma_forecast(rows, 0.5, 5).withColumn("s_ahead", F.abs(F.col("forecast") - F.col("c_now")))
    rows = windows.predictive_pvalues(rows)
    return rows.select("series_id", "t", "k", *[F.round(c, 9).alias(c) for c in ("c", "c_now", "s", "p", "forecast", "p_ahead")])


def forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Trend forecasts three steps ahead."""
    rows = windows.holt_forecast(_matrix_long(spark, folder), 3, window=5)
    return rows.select("series_id", "t", "k", F.round("forecast", 9).alias("holt"))


def moments(spark: SparkSession, folder: str) -> DataFrame:
    """Running mean and standard deviation, and the series normalised by its first steps."""
    rows = windows.running_moments(_matrix_long(spark, folder))
    scaled = windows.normalise(rows, 10)
    return scaled.select("series_id", "t", "k", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "x")])


def bets(spark: SparkSession, folder: str) -> DataFrame:
    """Every kind of bet on the p-values."""
    rows = windows.conformal_pvalues(windows.nonconformity(_matrix_long(spark, folder)))
    kinds = {
        "g_power": betting.power(0.5),
        "g_mixture": betting.mixture((0.5, 0.5), (0.3, 0.6)),
        "g_beta": betting.beta(0.5, 0.5),
        "g_default": betting.default(),
    }
    return rows.select("series_id", "t", "k", *[F.round(bet(F.col("p")), 5).alias(name) for name, bet in kinds.items()])


def martingales(spark: SparkSession, folder: str) -> DataFrame:
    """Wealth without resets, its sum, and each step's shares."""
    rows = windows.conformal_pvalues(windows.nonconformity(_matrix_long(spark, folder)))
    total = windows.sum_martingale(windows.log_martingale(rows))
    share = shares(F.col("logm"))
    parts = [F.round(F.get("logm", F.lit(k)), 6).alias(f"logm_{k}") for k in range(3)] + [F.round(F.get(share, F.lit(k)), 5).alias(f"share_{k}") for k in range(3)]
    return total.select("series_id", "t", *parts, F.round("total", 6).alias("total"), driver(F.col("logm")).alias("driver"))


def wealth_linear(spark: SparkSession, folder: str) -> DataFrame:
    """The same wealth on the linear scale, and the shares where nothing to divide gives zeros."""
    rows = windows.conformal_pvalues(windows.nonconformity(_matrix_long(spark, folder)))
    total = windows.sum_martingale(windows.log_martingale(rows))
    share = shares(F.col("logm"), "zero")
    parts = [F.round(wealth(F.get("logm", F.lit(k))), 5).alias(f"wealth_{k}") for k in range(3)] + [F.round(F.get(share, F.lit(k)), 5).alias(f"share_{k}") for k in range(3)]
    return total.select("series_id", "t", *parts)


def calibration(spark: SparkSession, folder: str) -> DataFrame:
    """The integrals of the bets, which are 1 for fair ones, by the trapezoid rule after p = u ** 4."""
    bets_ = {"power": betting.power(0.5), "mixture": betting.mixture((0.5, 0.5), (0.3, 0.6)), "beta": betting.beta(0.5, 0.5), "default": betting.default(), "own": OWN_BET}
    u = F.col("id") / F.lit(10_000.0)
    ends = F.when(F.col("id").isin(0, 10_000), 0.5).otherwise(1.0)
    sums = [F.round(F.sum(ends * bet(F.pow(u, F.lit(4.0))) * 4.0 * F.pow(u, F.lit(3.0))) / 10_000.0, 6).alias(name) for name, bet in bets_.items()]
    return spark.range(10_001).agg(*sums)


def joint_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Distances from the centroid under all four metrics."""
    x = _matrix(spark, folder)
    out = None
    for metric in METRICS:
        part = joint_scores(x, metric).withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    # A covariance of fewer than four rows is singular but for the ridge: few digits of it are sound.
    distance = F.when(F.col("metric") != "mahalanobis", F.round("s", 8)).when(F.col("t") < 4, F.round("s", -1)).otherwise(F.round("s", 4))
    return out.select("series_id", "t", "metric", distance.alias("s"))


# Detectors


def trace_trade(spark: SparkSession, folder: str) -> DataFrame:
    """The detector's trace over the monthly trade graphs."""
    return _rounded(detect(trade_features(spark, folder), TRADE), 2)


def trace_events(spark: SparkSession, folder: str) -> DataFrame:
    """The detector's trace over hourly event counts that rise halfway."""
    return _rounded(detect(event_features(spark, folder, SHIFT_AT), EVENTS), len(KINDS))


def alarms_events(spark: SparkSession, folder: str) -> DataFrame:
    """The alarms of the same, with what drove them."""
    found = detections(detect(event_features(spark, folder, SHIFT_AT), EVENTS))
    return found.withColumn("driver_pct", F.round("driver_pct", 6))


def trace_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The detector's trace over the feature matrix."""
    return _rounded(detect(_matrix(spark, folder), MATRIX), 3)


def trace_long(spark: SparkSession, folder: str) -> DataFrame:
    """The detector from the first step on, over ten-minute counts: a series of more than 4,000 steps."""
    return _rounded(detect(event_features(spark, folder, minutes=10), LONG), len(KINDS))


#: A bet of one's own that falls in a straight line.
OWN_BET = betting.custom("straight", lambda p: F.lit(1.5) - p, lambda p: 1.5 - np.asarray(p))


@dataclass(frozen=True)
class Last:
    """A forecaster of one's own: what was last is what comes next."""

    def predict_multi(self, window: np.ndarray, horizon: int) -> np.ndarray:
        return np.asarray(window)[-1]


def trace_own(spark: SparkSession, folder: str) -> DataFrame:
    """The detector with a bet and a forecaster of one's own."""
    return _rounded(detect(_matrix(spark, folder), DetectorConfig(**(BASE | {"threshold": 2.0, "betting": OWN_BET, "forecaster": Last()}))), 3)


#: Settings of the modes side by side: joint distances, a mixture of horizons, single streams, normalised features.
BASE = {"threshold": 5.0, "startup_period": 10, "history_size": 5, "horizon": 3, "cooldown": 5}
MODES: dict[str, dict] = {f"joint_{m}": {"detection_mode": "joint", "joint_distance": m} for m in METRICS} | {
    "mixture": {"horizon_weights": (0.5, 0.3, 0.2), "forecaster": Holt()},
    "holt": {"forecaster": Holt()},
    "observed": {"enable_horizon": False},
    "ahead": {"enable_traditional": False},
    "normalised": {"normalize_features": True},
}


def trace_modes(spark: SparkSession, folder: str) -> DataFrame:
    """The modes' traces."""
    traces = detect_many(_matrix(spark, folder), {name: DetectorConfig(**(BASE | extra)) for name, extra in MODES.items()})
    return traces.select("config", "series_id", "t", F.round("logm_trad", 6).alias("logm_trad"), F.round("logm_hrzn", 6).alias("logm_hrzn"), "fired")


#: Features are rounded to multiples of 1 / GRAIN where ties between scores must not depend on the order of sums.
GRAIN = 2**20


def _grained(features: DataFrame) -> DataFrame:
    return features.withColumn("x", F.transform("x", lambda v: F.rint(v * GRAIN) / GRAIN))


def trace_graph_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The detector with forecasts made of graphs instead of features."""
    snapshots, edges = _graph_tables(spark, folder)
    ahead = _grained(forecast_features(snapshots, edges, FORECAST, _few(SIMPLE)))
    return _rounded(detect(_grained(graphs.extract(snapshots, edges, _few(SIMPLE))), MATRIX, ahead=ahead), 3)


def _alarm_rows(chart: DataFrame) -> DataFrame:
    return chart.select("series_id", "t", F.round(F.array_max("score"), 5).alias("score"), "fired", "breach_k")


def cusum(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulative sums over the feature matrix."""
    return _alarm_rows(control_chart(_matrix(spark, folder), Cusum(startup_period=10)))


def ewma_chart(spark: SparkSession, folder: str) -> DataFrame:
    """Smoothed values over the feature matrix."""
    return _alarm_rows(control_chart(_matrix(spark, folder), EwmaChart(startup_period=10)))


# Evaluation


def _trials(spark: SparkSession, folder: str) -> DataFrame:
    x = _matrix(spark, folder)
    hits = None
    for name, chart in (("cusum", Cusum(startup_period=10)), ("ewma", EwmaChart(startup_period=10))):
        part = control_chart(x, chart).filter("fired").select(F.lit(name).alias("detector"), "series_id", "t")
        hits = part if hits is None else hits.unionByName(part)
    named = {"martingale": DetectorConfig(**(vars(MATRIX) | {"enable_horizon": False})), "horizon": MATRIX}
    hits = hits.unionByName(detect_many(x, named).filter("fired").select(F.col("config").alias("detector"), "series_id", "t"))
    steps = x.groupBy("series_id").agg((F.max("t") + 1).alias("steps"))
    units = steps.select("series_id", "steps", F.explode(F.array(*[F.lit(d) for d in ("cusum", "ewma", "martingale", "horizon")])).alias("detector"))
    return metrics.evaluate(units, hits, table(spark, folder, "change_points"), ["detector", "series_id"], DELTA)


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """How the alarms of four detectors match the true change points, per series."""
    return _trials(spark, folder).select("detector", "series_id", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "add")], "n_tp", "n_fp", "n_detections")


def sweep_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Means and deviations per detector."""
    found = metrics.summarise(_trials(spark, folder), ["detector"])
    return found.select(*[c if c in ("detector", "n_trials") else F.round(c, 9).alias(c) for c in found.columns])


def sweep_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Detectors from best to worst."""
    found = metrics.ranking(_trials(spark, folder), ["detector"])
    return found.select("detector", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "add")], "place")


def sweep_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Detectors side by side, a row per group of series."""
    grouped = _trials(spark, folder).withColumn("scenario", F.substring("series_id", 1, 5))
    return metrics.pivot_table(metrics.summarise(grouped, ["scenario", "detector"]), "scenario", "detector", ["cusum", "ewma", "horizon", "martingale"])


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    group = F.concat(F.lit("g"), F.substring("series_id", -1, 1).cast("int") % 3)
    return metrics.summarise(_trials(spark, folder).withColumn("scenario", group), ["scenario", "detector"])


def sweep_average(spark: SparkSession, folder: str) -> DataFrame:
    """Means per group of series and detector, and over the groups as one more."""
    found = metrics.with_average(_grouped(spark, folder), "scenario", ["detector"])
    return found.select("scenario", "detector", *[F.round(c, 9).alias(c) for c in ("tpr_mean", "fpr_mean", "add_mean")])


def sweep_overall(spark: SparkSession, folder: str) -> DataFrame:
    """Means over the groups' means."""
    found = metrics.overall(_grouped(spark, folder), ["detector"])
    return found.select("detector", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "add")])


def sweep_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A row per trial, written as CSV and read again."""
    target = f"{_folder(spark)}/trials"
    found = trials(spark, folder)
    metrics.write_csv(found, target)
    return spark.read.schema(found.schema).csv(target, header=True)


def synthetic_features(spark: SparkSession, folder: str) -> DataFrame:
    """All eight features of one sequence per scenario."""
    made = generate(spark, list(SCENARIOS), [0])
    x = graphs.extract(made.snapshots, made.edges)
    return x.select("series_id", "t", *[F.round(F.col("x")[i], 9).alias(n) for i, n in enumerate(graphs.names())])


SEEDS = 10
#: Four kinds of detectors side by side, each with its usual settings.
DETECTORS = {"martingale": DetectorConfig(enable_horizon=False), "horizon": DetectorConfig()}
CHARTS = {"cusum": Cusum(), "ewma": EwmaChart()}
#: One factor at a time: bets, joint distances, thresholds.
GRID: dict[str, DetectorConfig] = (
    {f"power_{e}": DetectorConfig(betting=betting.power(e)) for e in (0.2, 0.5, 0.7, 0.9)}
    | {"mixture": DetectorConfig()}
    | {f"beta_{a}_{b}": DetectorConfig(betting=betting.beta(a, b)) for a, b in ((0.2, 2.5), (0.4, 1.8), (0.6, 1.2))}
    | {f"joint_{m}": DetectorConfig(detection_mode="joint", joint_distance=m) for m in ("euclidean", "mahalanobis", "cosine", "chebyshev")}
    | {f"threshold_{t:g}": DetectorConfig(threshold=t) for t in (20.0, 50.0, 100.0)}
)


def _generated(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of all scenarios and seeds (computed once for all detectors), the series' lengths, and the truth."""
    made = generate(spark, list(SCENARIOS), list(range(SEEDS)))
    x = cut(graphs.extract(made.snapshots, made.edges))
    return x, x.groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("steps")), made.truth


def _score(hits: DataFrame, lengths: DataFrame, truth: DataFrame, names: list[str]) -> DataFrame:
    units = lengths.select("series_id", "steps", F.explode(F.array(*[F.lit(n) for n in names])).alias("detector"))
    found = metrics.evaluate(units, hits, truth, ["detector", "series_id"])
    return found.withColumn("scenario", F.substring_index("series_id", "/", 1))


def synthetic_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Four detectors over ten sequences of every scenario: means per detector over the scenarios' means."""
    x, lengths, truth = _generated(spark)
    hits = detect_many(x, DETECTORS).filter("fired").select(F.col("config").alias("detector"), "series_id", "t")
    for name, chart in CHARTS.items():
        hits = hits.unionByName(control_chart(x, chart).filter("fired").select(F.lit(name).alias("detector"), "series_id", "t"))
    trials = _score(hits, lengths, truth, [*DETECTORS, *CHARTS])
    return metrics.overall(metrics.summarise(trials, ["scenario", "detector"]), ["detector"])


def synthetic_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Fifteen configurations over the same sequences, from best to worst."""
    x, lengths, truth = _generated(spark)
    hits = detect_many(x, GRID).filter("fired").select(F.col("config").alias("detector"), "series_id", "t")
    return metrics.ranking(_score(hits, lengths, truth, list(GRID)), ["detector"])


# Streams


def _folder(spark: SparkSession) -> str:
    return own_folder(spark, "stream")


def stream_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """The contact pairs of each day, from the proximity log read as a stream to its end.

    A last row closes every day. The lateness covers the log's late readings however many micro-batches it comes in.
    """
    target = _folder(spark)
    schema = table(spark, folder, "proximity").schema
    # As a pattern the path may be a file as well as a folder.
    log = spark.readStream.schema(schema).parquet(f"{folder}/proximity.parque[t]").filter(F.col("time") >= F.lit("2008-09-19").cast("timestamp_ntz"))
    log = with_end(log.withColumn("at", F.col("time").cast("timestamp")), "at", USER, PEER, target)
    return run_to_end(daily_contacts_stream(log, "at", USER, PEER, "45 days"), target).filter(F.col("u") != LAST_PAIR[0])


def trace_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The detector over the feature matrix, called from SQL."""
    register(spark)
    _matrix(spark, folder).selectExpr("cast(series_id AS string) AS series_id", "t", "x").createOrReplaceTempView("driftloom_matrix")
    found = spark.sql("SELECT * FROM detect_changes(TABLE(driftloom_matrix) PARTITION BY series_id ORDER BY (t), 5.0D, 10, 5, 3, 5)")
    return found.select("series_id", "t", F.round("logm_trad", 6).alias("logm_trad"), F.round("logm_hrzn", 6).alias("logm_hrzn"), "fired", "fired_by")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of the proximity log read as a stream to its end."""
    target = _folder(spark)
    log = spark.readStream.schema(table(spark, folder, "proximity").schema).parquet(f"{folder}/proximity.parque[t]")
    log = log.filter(F.col("time") >= F.lit("2008-09-19").cast("timestamp_ntz")).withColumn("at", F.col("time").cast("timestamp"))
    found = run_to_end(sessions_stream(with_end(log, "at", USER, PEER, target), USER, "at", 1800, "45 days"), target)
    ends = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")]
    return found.filter(F.col("entity").isNull() | (F.col("entity") != LAST_PAIR[0])).select(F.col("entity").alias("user_id"), *ends, "n_events")


def stream_trace(spark: SparkSession, folder: str) -> DataFrame:
    """The detector's trace over the feature matrix, step by step from a stream."""
    target = _folder(spark)
    _matrix(spark, folder).select(F.col("series_id"), "t", "x").write.parquet(f"{target}/in")
    rows = spark.readStream.schema("series_id string, t int, x array<double>").parquet(f"{target}/in")
    return _rounded(run_to_end(detect_stream(rows, MATRIX), target), 3, with_p=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        trace_trade, proximity_edges, proximity_csv, proximity_days, proximity_labels, proximity_run, proximity_trace, trade_edges, matrix_clean, graph_counts, graph_clustering, graph_paths,
        graph_features, graph_spectrum, graph_custom, graph_forecast, graph_diagnostics, graph_blend, conformal, forecasts, moments, bets, martingales, wealth_linear, calibration, joint_distances, trace_events, alarms_events,
        trace_matrix, trace_long, trace_own, trace_modes, trace_graph_forecast, cusum, ewma_chart, trials, sweep_summary, sweep_ranking, sweep_pivot, sweep_average, sweep_overall, sweep_csv, synthetic_features, synthetic_sweep, synthetic_grid,
        stream_contacts, stream_sessions, stream_trace, trace_sql,
    )
}

# SQL

_CONTACTS = """
    SELECT date_diff('day', DATE '2008-09-19', CAST("time" AS DATE))::INT AS t, "user.id" AS a, "remote.user.id.if.known" AS b FROM proximity
    WHERE "user.id" IS NOT NULL AND "remote.user.id.if.known" IS NOT NULL AND coalesce(prob2, 0::FLOAT) >= {0}::FLOAT
      AND "time" >= TIMESTAMP '2008-09-19' AND "time" < TIMESTAMP '2008-09-19' + INTERVAL 289 DAY"""
_NODES = """
    WITH contacts AS ({0}), nodes AS (SELECT u AS user_id, (row_number() OVER (ORDER BY u) - 1)::INT AS node
        FROM (SELECT a AS u FROM contacts UNION SELECT b FROM contacts)),
    edges_ AS (SELECT DISTINCT t, least(x.node, y.node) AS u, greatest(x.node, y.node) AS v
        FROM contacts JOIN nodes x ON a = x.user_id JOIN nodes y ON b = y.user_id WHERE a <> b)"""
_DAYS = _NODES.format(_CONTACTS.format("0.0")) + """,
    per_day AS (SELECT r.t::INT AS t, (SELECT count(*) FROM nodes)::INT AS n, count(e.u) AS m FROM range(289) r(t) LEFT JOIN edges_ e ON e.t = r.t GROUP BY 1)"""
_EDGES = """
    e AS (SELECT DISTINCT series_id, t, least(u, v) AS u, greatest(u, v) AS v FROM edges WHERE u <> v)"""
_TRADE = """
    pairs AS (SELECT ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INT AS t, least(c_nationkey, s_nationkey) AS u,
        greatest(c_nationkey, s_nationkey) AS v, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3),
    trade AS (SELECT t, u, v FROM (SELECT *, sum(w) OVER (PARTITION BY t) AS a, count(*) OVER (PARTITION BY t) AS c FROM pairs) WHERE w * c >= a)"""
_TRADE_X = f"""
    WITH {_TRADE}, m AS (SELECT t, count(*) AS m FROM trade GROUP BY 1),
    tri AS (SELECT a.t, count(*) AS n FROM trade a JOIN trade b ON a.t = b.t AND a.v = b.u JOIN trade c ON c.t = a.t AND c.u = a.u AND c.v = b.v GROUP BY 1),
    w AS (SELECT t, m.m, coalesce(tri.n, 0) AS n FROM m LEFT JOIN tri USING (t))
    SELECT 'trade' AS series_id, t, 0 AS k, m::DOUBLE AS x FROM w UNION ALL SELECT 'trade', t, 1, n::DOUBLE FROM w"""


def _events_x(shift_at: int | None, minutes: int = 60) -> str:
    lift = f"CASE WHEN s.t >= {shift_at} THEN 20 ELSE 0 END" if shift_at is not None else "0"
    return f"""
    WITH ev AS (SELECT ((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 1440 + hour(ts) * 60 + minute(ts)) // {minutes})::INT AS t, event_type FROM events),
    kinds AS (SELECT unnest({list(KINDS)}) AS kind, unnest(range({len(KINDS)}))::INT AS k),
    spine AS (SELECT unnest(range((SELECT max(t) + 1 FROM ev)))::INT AS t)
    SELECT 'events' AS series_id, s.t, kinds.k, count(ev.t)::DOUBLE + {lift} AS x
    FROM spine s CROSS JOIN kinds LEFT JOIN ev ON ev.t = s.t AND ev.event_type = kinds.kind GROUP BY s.t, kinds.k"""


_EVENTS_X = _events_x(SHIFT_AT)
_MATRIX_X = """
    SELECT series_id, t, k, coalesce(last_value(CASE WHEN isnan(v) THEN NULL ELSE v END IGNORE NULLS)
        OVER (PARTITION BY series_id, k ORDER BY t ROWS UNBOUNDED PRECEDING), 0.0) AS x
    FROM (SELECT series_id, t, unnest(coalesce(x, [NULL, NULL, NULL]::DOUBLE[])) AS v, unnest(range(3))::INT AS k
        FROM (SELECT series_id, t, arg_max(x, computed_at) FILTER (WHERE x IS NOT NULL) AS x FROM feature_matrix GROUP BY 1, 2))"""
_PRIOR = "OVER (PARTITION BY series_id, k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SCORES = f"""
    WITH RECURSIVE xs AS MATERIALIZED ({_MATRIX_X}),
    cs AS (SELECT *, avg(x) {_PRIOR} AS c, avg(x) OVER (PARTITION BY series_id, k ORDER BY t ROWS UNBOUNDED PRECEDING) AS c_now FROM xs),
    ss AS MATERIALIZED (SELECT *, coalesce(abs(x - c), 0) AS s FROM cs),
    rk AS (SELECT a.series_id, a.t, a.k, count(b.t) AS n, count(CASE WHEN b.s > a.s THEN 1 END) AS gt, count(CASE WHEN b.s = a.s THEN 1 END) AS eq
        FROM ss a LEFT JOIN ss b ON a.series_id = b.series_id AND a.k = b.k AND b.t < a.t GROUP BY 1, 2, 3),
    pv AS MATERIALIZED (SELECT series_id, t, k, n, CASE WHEN n > 0 THEN (gt + {theta_sql(0, "series_id", "t", "k")} * (1 + eq)) / (n + 1)::DOUBLE END AS p FROM rk)"""


def _bet_sql(kind: str) -> str:
    return f"CASE WHEN p IS NOT NULL THEN round({_bet_expr(kind)}, 5) END AS g_{kind}"


def _bet_expr(kind: str) -> str:
    c = "greatest(1e-10::DOUBLE, least(1.0::DOUBLE, p))"
    power = lambda e: f"{e}::DOUBLE * pow({c}, {e}::DOUBLE - 1.0::DOUBLE)"
    beta = "1.0::DOUBLE / (pi() * sqrt({0}) * sqrt(1.0::DOUBLE - {0}))".format("greatest(1e-10::DOUBLE, least(1.0::DOUBLE - 1e-10::DOUBLE, p))")
    return {"power": power(0.5), "mixture": f"0.5::DOUBLE * ({power(0.3)}) + 0.5::DOUBLE * ({power(0.6)})", "beta": beta, "default": default_bet("p")}[kind]


def _chart_sql(kind: str) -> str:
    """A control chart over the feature matrix with start-up 10, as a recursive query."""
    zeros = "list_transform(m, lambda v: 0.0::DOUBLE)"
    base = f"""
    WITH RECURSIVE xs AS MATERIALIZED ({_MATRIX_X}),
    ms AS (SELECT *, avg(x) {_PRIOR} AS mean, stddev_samp(x) {_PRIOR} AS sd FROM xs),
    st AS MATERIALIZED (SELECT series_id, t, list(x ORDER BY k) AS x, list(mean ORDER BY k) AS m, list(sd ORDER BY k) AS sd,
        list(CASE WHEN sd > 0 THEN (x - mean) / sd ELSE 0 END ORDER BY k) AS z FROM ms WHERE t >= 10 GROUP BY 1, 2),"""
    if kind == "cusum":
        up = "list_transform(list_zip(f.up, s.z), lambda q: greatest(0.0::DOUBLE, q[1] + q[2] - 0.5))"
        down = "list_transform(list_zip(f.down, s.z), lambda q: greatest(0.0::DOUBLE, q[1] - q[2] - 0.5))"
        return base + f"""
    fold AS (SELECT series_id, 9 AS t, {zeros} AS up, {zeros} AS down, {zeros} AS sc, false AS fired FROM st WHERE t = 10
        UNION ALL SELECT series_id, t, CASE WHEN hit THEN {zeros} ELSE up END, CASE WHEN hit THEN {zeros} ELSE down END, sc, hit
        FROM (SELECT *, list_max(sc) >= 5.0 AS hit FROM (SELECT *, list_transform(list_zip(up, down), lambda q: greatest(q[1], q[2])) AS sc
            FROM (SELECT s.series_id, s.t, s.m, {up} AS up, {down} AS down FROM fold f JOIN st s ON s.series_id = f.series_id AND s.t = f.t + 1)))),"""
    assert kind == "ewma"
    z = "list_transform(list_zip(f.z, s.x, s.m), lambda q: 0.3 * q[2] + 0.7 * CASE WHEN f.t = 9 THEN q[3] ELSE q[1] END)"
    factor = "sqrt(0.3::DOUBLE / 1.7::DOUBLE * (1.0::DOUBLE - pow(0.7::DOUBLE, 2.0 * (t - 9))))"
    score = f"list_transform(list_zip(z, m, sd), lambda q: CASE WHEN q[3] > 0 THEN abs(q[1] - q[2]) / (q[3] * {factor}) ELSE 0 END)"
    return base + f"""
    fold AS (SELECT series_id, 9 AS t, {zeros} AS z, {zeros} AS sc, false AS fired FROM st WHERE t = 10
        UNION ALL SELECT series_id, t, CASE WHEN hit THEN m ELSE z END, sc, hit
        FROM (SELECT *, list_max(sc) > 3.0 AS hit FROM (SELECT *, {score} AS sc
            FROM (SELECT s.series_id, s.t, s.m, s.sd, {z} AS z FROM fold f JOIN st s ON s.series_id = f.series_id AND s.t = f.t + 1)))),"""


_CHART_ROWS = """
    all_ AS (SELECT DISTINCT series_id, t FROM xs)
    SELECT a.series_id, a.t, coalesce(round(list_max(f.sc), 5), 0) AS score, coalesce(f.fired, false) AS fired,
        CASE WHEN f.fired THEN (list_position(f.sc, list_max(f.sc)) - 1)::INT END AS breach_k
    FROM all_ a LEFT JOIN fold f ON a.series_id = f.series_id AND a.t = f.t"""
_DISTANCE = f"""
    WITH xs AS ({_MATRIX_X}), cs AS (SELECT *, avg(x) {_PRIOR} AS c FROM xs),
    w AS (SELECT series_id, t, list(x ORDER BY k) AS x, list(coalesce(c, 0) ORDER BY k) AS c0, list(x - coalesce(c, 0) ORDER BY k) AS d FROM cs GROUP BY 1, 2),
    w1 AS (SELECT *, x[1] AS x1, x[2] AS x2, x[3] AS x3 FROM w),
    q AS (SELECT *, {spread_sql(3, "p")} FROM w1 WINDOW p AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    """ + " UNION ALL ".join(f"SELECT series_id, t, '{m}' AS metric, round({distance_sql(m, 3, 'x', 'c0', 'd', 't')}, {'CASE WHEN t < 4 THEN -1 ELSE 4 END' if m == 'mahalanobis' else 8}) AS s FROM q" for m in METRICS)
_HITS = " UNION ALL ".join(
    [f"SELECT '{k}' AS detector, series_id, t FROM ({_chart_sql(k)} none_ AS (SELECT 1) SELECT series_id, t FROM fold WHERE fired)" for k in ("cusum", "ewma")]
    + [
        f"SELECT '{name}' AS detector, series_id, t FROM ({detector_sql(_MATRIX_X, 10, 5, 5.0, 5, final='alarms', ahead=ahead)})"
        for name, ahead in (("martingale", False), ("horizon", True))
    ]
)
_TRIALS = f"""
    WITH al AS MATERIALIZED ({_HITS}), kinds AS (SELECT unnest(['cusum', 'ewma', 'martingale', 'horizon']) AS detector),
    units AS (SELECT detector, series_id, max(t) + 1 AS steps FROM feature_matrix, kinds GROUP BY 1, 2), tr AS (SELECT series_id, count(*) AS n FROM change_points GROUP BY 1),
    hit AS (SELECT detector, c.series_id, c.cp, min(al.t) AS t FROM change_points c JOIN al ON al.series_id = c.series_id AND al.t BETWEEN c.cp AND c.cp + {DELTA} GROUP BY 1, 2, 3),
    tp AS (SELECT detector, series_id, count(*) AS n, avg(t - cp) AS d FROM hit GROUP BY 1, 2),
    fp AS (SELECT detector, series_id, count(*) AS n FROM al WHERE NOT EXISTS (SELECT 1 FROM change_points c WHERE c.series_id = al.series_id AND al.t BETWEEN c.cp AND c.cp + {DELTA}) GROUP BY 1, 2),
    nd AS (SELECT detector, series_id, count(*) AS n FROM al GROUP BY 1, 2),
    trial AS (SELECT detector, series_id, coalesce(tp.n, 0)::INT AS n_tp, coalesce(fp.n, 0)::INT AS n_fp, coalesce(tp.n, 0) / tr.n::DOUBLE AS tpr, coalesce(fp.n, 0) / (steps - coalesce(tr.n, 0) * {DELTA + 1})::DOUBLE AS fpr, tp.d AS add,
        coalesce(nd.n, 0)::INT AS n_detections FROM units LEFT JOIN tp USING (detector, series_id) LEFT JOIN fp USING (detector, series_id) LEFT JOIN nd USING (detector, series_id)
        LEFT JOIN tr USING (series_id)),
    means AS (SELECT detector, count(*) AS n_trials, {", ".join(f"round(avg({m}), 9) AS {m}_mean, round(CASE WHEN count({m}) > 0 THEN coalesce(stddev_samp({m}), 0) END, 9) AS {m}_std" for m in ("tpr", "fpr", "add"))},
        round(avg(n_detections), 9) AS n_detections_mean FROM trial GROUP BY 1)"""

_FORECAST_EDGES = f"""WITH {_EDGES}, w AS (SELECT series_id, t + age AS t, u, v, sum(pow(0.5::DOUBLE, age + 1)) AS weight
            FROM e, (SELECT unnest(range(5))::INT AS age) GROUP BY 1, 2, 3, 4),
        m AS (SELECT series_id, t, count(*) AS m FROM e GROUP BY 1, 2),
        d AS (SELECT series_id, t, n, coalesce(m, 0) / (n * (n - 1) / 2.0::DOUBLE) AS density FROM snapshots LEFT JOIN m USING (series_id, t)),
        k AS (SELECT series_id, t, round_even(round(avg(density) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) * (n * (n - 1) / 2.0::DOUBLE), 9), 0)::INT AS target,
            t - min(t) OVER (PARTITION BY series_id) AS age FROM d)
        SELECT series_id, t, u, v FROM (SELECT series_id, t, u, v, target, row_number() OVER (PARTITION BY series_id, t ORDER BY round(weight, 12) DESC, u, v) AS place
            FROM w JOIN k USING (series_id, t) WHERE age >= 4) WHERE place <= target"""


def _clusters(edges: str, nodes: str) -> str:
    """Degree, clustering and density of each snapshot of ``nodes`` (series_id, t, n) with the edges of ``edges``, as features 0, 1 and 2."""
    return f"""WITH e AS (SELECT DISTINCT series_id, t, least(u, v) AS u, greatest(u, v) AS v FROM {edges} WHERE u <> v),
        ends_ AS (SELECT series_id, t, u AS a, v AS b FROM e UNION ALL SELECT series_id, t, v, u FROM e),
        deg AS (SELECT series_id, t, a, count(*) AS d FROM ends_ GROUP BY 1, 2, 3),
        tri AS (SELECT x.series_id, x.t, x.a, count(*) / 2 AS n FROM ends_ x JOIN ends_ y ON x.series_id = y.series_id AND x.t = y.t AND x.b = y.a
            JOIN ends_ z ON z.series_id = x.series_id AND z.t = x.t AND z.a = y.b AND z.b = x.a GROUP BY 1, 2, 3),
        per AS (SELECT series_id, t, sum(d) / 2 AS m, sum(CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(tri.n, 0) / (d * (d - 1)) ELSE 0 END) AS c
            FROM deg LEFT JOIN tri USING (series_id, t, a) GROUP BY 1, 2),
        w AS (SELECT series_id, t, n, coalesce(m, 0)::DOUBLE AS m, coalesce(c, 0) / n AS c FROM {nodes} LEFT JOIN per USING (series_id, t))
        SELECT series_id, t, k, CASE k WHEN 0 THEN 2.0 * m / n WHEN 1 THEN c ELSE 2.0 * m / (n::DOUBLE * (n - 1)) END AS x FROM w CROSS JOIN (SELECT unnest(range(3))::INT AS k)"""


def _graph_x(edges: str, name: str = "x", late: int = 0) -> str:
    return f"SELECT series_id, t, k, round_even(x * {GRAIN}, 0) / {GRAIN} AS {name} FROM ({_clusters(edges, 'snapshots')}) WHERE t >= {late}"


def _mode_sql(extra: dict) -> str:
    holt = extra.get("forecaster")
    return detector_sql(
        _MATRIX_X, 10, 5, 5.0, 5, horizon=3, ahead=extra.get("enable_horizon", True), observed=extra.get("enable_traditional", True), joint=extra.get("joint_distance"),
        weights=extra.get("horizon_weights"), holt=(holt.alpha, holt.beta) if holt else None, scaled=extra.get("normalize_features", False),
    )


_PROXIMITY_X = _clusters(
    "(" + _NODES.format(_CONTACTS.format("0.0")) + " SELECT 'proximity' AS series_id, t, u, v FROM edges_)",
    "(" + _NODES.format(_CONTACTS.format("0.0")) + " SELECT 'proximity' AS series_id, r.t::INT AS t, (SELECT count(*) FROM nodes)::INT AS n FROM range(289) r(t))",
)

_GROUPS = """, cell AS (SELECT detector, 'g' || (right(series_id, 1)::INT % 3) AS scenario, avg(tpr) AS tpr, avg(fpr) AS fpr, avg(add) AS add FROM trial GROUP BY 1, 2)"""
#: The running wealth of every feature from p-values, without resets.
_WEALTH = f""",
        lg AS MATERIALIZED (SELECT series_id, t, list(coalesce(ln(greatest({default_bet("p")}, 1e-300::DOUBLE)), 0) ORDER BY k) AS y FROM pv WHERE t > 0 GROUP BY 1, 2),
        fold AS (SELECT DISTINCT series_id, 0 AS t, [0.0::DOUBLE, 0.0, 0.0] AS m FROM pv
            UNION ALL SELECT f.series_id, l.t, list_transform(list_zip(f.m, l.y), lambda z: greatest(z[1] + z[2], ln(1e-300::DOUBLE))) FROM fold f JOIN lg l ON l.series_id = f.series_id AND l.t = f.t + 1)"""


def _integral(g: str) -> str:
    """The trapezoid rule over u = 0, 1 / 10000, .., 1 for a bet on p = u ** 4."""
    return f"round(sum(CASE WHEN i IN (0, 10000) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * ({g}) * 4.0::DOUBLE * pow(u, 3)) / 10000.0::DOUBLE, 6)"


SQL: dict[str, str] = {
    "sweep_summary": _TRIALS + " SELECT * FROM means",
    "sweep_ranking": _TRIALS + """ SELECT detector, tpr_mean AS tpr, fpr_mean AS fpr, add_mean AS add,
        row_number() OVER (ORDER BY tpr_mean DESC NULLS LAST, add_mean NULLS LAST, detector)::INT AS place FROM means""",
    "proximity_edges": _NODES.format(_CONTACTS.format("0.3")) + " SELECT 'proximity' AS series_id, t, u, v FROM edges_",
    "proximity_csv": _NODES.format(_CONTACTS.format("0.3")) + " SELECT 'proximity' AS series_id, t, u, v FROM edges_",
    "proximity_days": _DAYS + " SELECT t, n, m, 2.0 * m / n AS mean_degree, 2.0 * m / (n::DOUBLE * (n - 1)) AS density FROM per_day",
    "proximity_labels": _DAYS + " SELECT day AS t, label, m FROM event_labels LEFT JOIN per_day ON day = t",
    "trade_edges": f"WITH {_TRADE} SELECT 'trade' AS series_id, t, u, v FROM trade",
    "matrix_clean": _MATRIX_X,
    "graph_counts": f"""WITH {_EDGES}, m AS (SELECT series_id, t, count(*) AS m FROM e GROUP BY 1, 2)
        SELECT series_id, t, n, coalesce(m, 0) AS m, 2.0 * coalesce(m, 0) / n AS mean_degree, 2.0 * coalesce(m, 0) / (n::DOUBLE * (n - 1)) AS density
        FROM snapshots LEFT JOIN m USING (series_id, t)""",
    "graph_clustering": f"""WITH {_EDGES}, ends_ AS (SELECT series_id, t, u AS a, v AS b FROM e UNION ALL SELECT series_id, t, v, u FROM e),
        deg AS (SELECT series_id, t, a, count(*) AS d FROM ends_ GROUP BY 1, 2, 3),
        tri AS (SELECT x.series_id, x.t, x.a, count(*) / 2 AS n FROM ends_ x JOIN ends_ y ON x.series_id = y.series_id AND x.t = y.t AND x.b = y.a
            JOIN ends_ z ON z.series_id = x.series_id AND z.t = x.t AND z.a = y.b AND z.b = x.a GROUP BY 1, 2, 3),
        per AS (SELECT series_id, t, sum(coalesce(tri.n, 0)) / 3 AS triangles, sum(CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(tri.n, 0) / (d * (d - 1)) ELSE 0 END) AS c
            FROM deg LEFT JOIN tri USING (series_id, t, a) GROUP BY 1, 2)
        SELECT series_id, t, coalesce(triangles, 0)::BIGINT AS triangles, round(coalesce(c, 0) / n, 9) AS mean_clustering FROM snapshots LEFT JOIN per USING (series_id, t)""",
    "graph_paths": f"""WITH RECURSIVE {_EDGES}, ends_ AS (SELECT series_id, t, u AS a, v AS b FROM e UNION ALL SELECT series_id, t, v, u FROM e),
        reach(series_id, t, s, x, d) USING KEY (series_id, t, s, x) AS (SELECT DISTINCT series_id, t, a, a, 0 FROM ends_
            UNION SELECT r.series_id, r.t, r.s, b.b, r.d + 1 FROM reach r JOIN ends_ b ON b.series_id = r.series_id AND b.t = r.t AND b.a = r.x
            WHERE NOT EXISTS (SELECT 1 FROM recurring.reach o WHERE o.series_id = r.series_id AND o.t = r.t AND o.s = r.s AND o.x = b.b)),
        node AS (SELECT series_id, t, s, count(*) AS r, sum(d) AS far, sum(greatest(d - 1, 0)) AS inner_ FROM reach GROUP BY 1, 2, 3),
        per AS (SELECT series_id, t, sum(inner_) AS i, sum(CASE WHEN far > 0 THEN (r - 1)::DOUBLE / far * (r - 1) ELSE 0 END) AS c FROM node GROUP BY 1, 2)
        SELECT series_id, t, round(coalesce(i, 0) / (n::DOUBLE * (n - 1) * (n - 2)), 9) AS mean_betweenness,
            round(coalesce(c, 0) / (n::DOUBLE * (n - 1)), 9) AS mean_closeness FROM snapshots LEFT JOIN per USING (series_id, t)""",
    "graph_spectrum": f"""WITH RECURSIVE {_EDGES}, ends_ AS (SELECT series_id, t, u AS a, v AS b FROM e UNION ALL SELECT series_id, t, v, u FROM e),
        deg AS (SELECT series_id, t, a, count(*) AS d FROM ends_ GROUP BY 1, 2, 3),
        sums AS (SELECT series_id, t, sum(d)::DOUBLE AS d1, sum(d * d)::DOUBLE AS d2, count(*) AS touched FROM deg GROUP BY 1, 2),
        tri AS (SELECT a.series_id, a.t, count(*) AS c FROM e a JOIN e b ON a.series_id = b.series_id AND a.t = b.t AND a.v = b.u
            JOIN e c ON c.series_id = a.series_id AND c.t = a.t AND c.u = a.u AND c.v = b.v GROUP BY 1, 2),
        reach(series_id, t, x) USING KEY (series_id, t, x) AS (SELECT series_id, t, 0 FROM snapshots
            UNION SELECT r.series_id, r.t, b.b FROM reach r JOIN ends_ b ON b.series_id = r.series_id AND b.t = r.t AND b.a = r.x
            WHERE NOT EXISTS (SELECT 1 FROM recurring.reach o WHERE o.series_id = r.series_id AND o.t = r.t AND o.x = b.b)),
        reached AS (SELECT series_id, t, count(*) AS c FROM reach GROUP BY 1, 2)
        SELECT series_id, t, coalesce(d1, 0) AS laplacian_sum, coalesce(d1 + d2, 0) AS laplacian_squares, (reached.c = n)::INT::DOUBLE AS connected,
            coalesce(d1, 0) AS adjacency_squares, 6.0::DOUBLE * coalesce(tri.c, 0) AS adjacency_cubes, 0.0::DOUBLE AS leading_residual
        FROM snapshots JOIN reached USING (series_id, t) LEFT JOIN sums USING (series_id, t) LEFT JOIN tri USING (series_id, t)""",
    "graph_custom": f"""WITH {_EDGES}, tri AS (SELECT a.series_id, a.t, count(*) AS c FROM e a JOIN e b ON a.series_id = b.series_id AND a.t = b.t AND a.v = b.u
            JOIN e c ON c.series_id = a.series_id AND c.t = a.t AND c.u = a.u AND c.v = b.v GROUP BY 1, 2)
        SELECT series_id, t, round(3.0::DOUBLE * coalesce(c, 0) / n, 9) AS triangle_count FROM snapshots LEFT JOIN tri USING (series_id, t)""",
    "graph_forecast": _FORECAST_EDGES,
    "graph_blend": f"""WITH RECURSIVE {_EDGES}, f AS ({_FORECAST_EDGES}),
        w AS (SELECT series_id, t + age AS t, u, v, sum(pow(0.5::DOUBLE, age + 1)) / {sum(0.5**j for j in range(1, 6))!r}::DOUBLE AS w
            FROM e, (SELECT unnest(range(5))::INT AS age) GROUP BY 1, 2, 3, 4),
        pairs AS (SELECT series_id, t, u, v, coalesce(w, 0) AS w, (f.u IS NOT NULL)::INT AS f, (e.u IS NOT NULL)::INT AS a
            FROM w FULL JOIN e USING (series_id, t, u, v) FULL JOIN f USING (series_id, t, u, v)),
        gaps AS (SELECT series_id, t, sqrt(2.0::DOUBLE * sum((w - a) * (w - a))) - sqrt(2.0::DOUBLE * sum((f - a) * (f - a))) AS delta FROM pairs GROUP BY 1, 2),
        st AS MATERIALIZED (SELECT series_id, t::INT AS t, coalesce(delta, 0) AS delta FROM snapshots LEFT JOIN gaps USING (series_id, t) WHERE t >= 4),
        fold AS (SELECT series_id, t, delta, 0.5::DOUBLE * delta AS ema, 0.0::DOUBLE AS before FROM st WHERE t = 4
            UNION ALL SELECT s.series_id, s.t, s.delta, 0.5::DOUBLE * s.delta + 0.5::DOUBLE * f.ema, f.ema FROM fold f JOIN st s ON s.series_id = f.series_id AND s.t = f.t + 1)
        SELECT series_id, t, round(delta, 8) AS delta, round(ema, 8) AS delta_ema, round(1.0::DOUBLE / (1.0 + exp(before)), 8) AS beta FROM fold""",
    "graph_diagnostics": f"""WITH {_EDGES}, f AS ({_FORECAST_EDGES}),
        nodes AS (SELECT series_id, t, n, unnest(range(n))::INT AS x FROM snapshots),
        de AS (SELECT series_id, t, x, count(*) AS d FROM (SELECT series_id, t, u AS x FROM e UNION ALL SELECT series_id, t, v FROM e) GROUP BY 1, 2, 3),
        df AS (SELECT series_id, t, x, count(*) AS d FROM (SELECT series_id, t, u AS x FROM f UNION ALL SELECT series_id, t, v FROM f) GROUP BY 1, 2, 3),
        w AS (SELECT series_id, t, x, n, avg(coalesce(d, 0)) OVER p AS mean, stddev_pop(coalesce(d, 0)) OVER p AS sd FROM nodes LEFT JOIN de USING (series_id, t, x)
            WINDOW p AS (PARTITION BY series_id, x ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
        z AS (SELECT series_id, t, n, mean, coalesce(d, 0) AS d, (coalesce(d, 0) - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM w LEFT JOIN df USING (series_id, t, x) WHERE t >= 4)
        SELECT series_id, t, round(avg(z * z), 6) AS degree_gap, round(abs(sum(d) / 2.0::DOUBLE - sum(mean) / 2.0::DOUBLE) / greatest(n * (n - 1) / 2.0::DOUBLE, 1), 9) AS sparsity_gap FROM z GROUP BY series_id, t, n""",
    "conformal": _SCORES + """,
        wt AS (SELECT unnest(range(5))::INT AS j),
        fc AS (SELECT a.series_id, a.t, a.k, sum(pow(0.5::DOUBLE, j) * b.x) / sum(pow(0.5::DOUBLE, j)) AS f FROM ss a, wt JOIN ss b
            ON b.series_id = a.series_id AND b.k = a.k AND b.t = a.t - wt.j GROUP BY 1, 2, 3),
        ah AS (SELECT a.series_id, a.t, a.k, a.f, (count(CASE WHEN b.s >= abs(a.f - a.c_now) THEN 1 END) + 1)::DOUBLE / (count(b.t) + 1) AS p_ahead
            FROM (SELECT fc.*, ss.c_now FROM fc JOIN ss USING (series_id, t, k)) a LEFT JOIN ss b ON a.series_id = b.series_id AND a.k = b.k AND b.t < a.t GROUP BY 1, 2, 3, 4)
        SELECT series_id, t, k, round(c, 9) AS c, round(c_now, 9) AS c_now, round(s, 9) AS s, round(p, 9) AS p, round(f, 9) AS forecast, round(p_ahead, 9) AS p_ahead
        FROM ss JOIN pv USING (series_id, t, k) JOIN ah USING (series_id, t, k)""",
    "forecasts": f"""WITH xs AS ({_MATRIX_X}), w AS (SELECT series_id, t, k, x, list(x) OVER (PARTITION BY series_id, k ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS h FROM xs),
        f AS (SELECT series_id, t, k, x, len(h) AS n, list_reduce(list_prepend({{'l': h[1], 'd': h[2] - h[1]}}, list_transform(h[2:], lambda v: {{'l': v, 'd': 0.0::DOUBLE}})),
            lambda a, b: {{'l': 0.3 * b.l + 0.7 * (a.l + a.d), 'd': 0.1 * (0.3 * b.l + 0.7 * (a.l + a.d) - a.l) + 0.9 * a.d}}) AS st FROM w)
        SELECT series_id, t, k, round(CASE WHEN n < 2 THEN x ELSE st.l + 3 * st.d END, 9) AS holt FROM f""",
    "moments": f"""WITH xs AS ({_MATRIX_X}), f AS (SELECT series_id, k, avg(x) AS mu, stddev_samp(x) AS sigma FROM xs WHERE t < 10 GROUP BY 1, 2)
        SELECT series_id, t, k, round(avg(x) OVER w, 9) AS mean, round(stddev_samp(x) OVER w, 9) AS sd,
            round((x - mu) / CASE WHEN coalesce(sigma, 0) < 1e-10 THEN 1 ELSE sigma END, 9) AS x FROM xs JOIN f USING (series_id, k)
        WINDOW w AS (PARTITION BY series_id, k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "bets": _SCORES + " SELECT series_id, t, k, " + ", ".join(_bet_sql(k) for k in ("power", "mixture", "beta", "default")) + " FROM pv",
    "wealth_linear": _SCORES + _WEALTH + " SELECT series_id, t, "
        + ", ".join(f"round(exp(m[{k + 1}]), 5) AS wealth_{k}, round(100.0 * exp(m[{k + 1}] - {lse('m')}), 5) AS share_{k}" for k in range(3)) + " FROM fold",
    "calibration": "WITH k AS (SELECT i, i / 10000.0::DOUBLE AS u, pow(i / 10000.0::DOUBLE, 4) AS p FROM range(10001) r(i)) SELECT "
        + ", ".join(f"{_integral(_bet_expr(kind))} AS {kind}" for kind in ("power", "mixture", "beta", "default")) + f", {_integral('1.5::DOUBLE - p')} AS own FROM k",
    "martingales": _SCORES + _WEALTH + f"""
        SELECT series_id, t, round(m[1], 6) AS logm_0, round(m[2], 6) AS logm_1, round(m[3], 6) AS logm_2, round(s[1], 5) AS share_0, round(s[2], 5) AS share_1, round(s[3], 5) AS share_2,
            round({lse("m")}, 6) AS total, (list_position(m, list_max(m)) - 1)::INT AS driver
        FROM (SELECT *, list_transform(m, lambda v: 100.0 * exp(v - {lse("m")})) AS s FROM fold)""",
    "joint_distances": _DISTANCE,
    "trace_trade": detector_sql(_TRADE_X, 12, 6, 8.0, 6, k=2, horizon=5),
    "trace_events": detector_sql(_EVENTS_X, 20, 20, 8.0, 20, k=len(KINDS), horizon=5),
    "alarms_events": detector_sql(_EVENTS_X, 20, 20, 8.0, 20, final="alarms", k=len(KINDS), horizon=5),
    "trace_long": detector_sql(_events_x(None, 10), 0, 6, 20.0, 20, k=len(KINDS), horizon=5),
    "trace_matrix": detector_sql(_MATRIX_X, 10, 5, 5.0, 5, horizon=3),
    "stream_trace": detector_sql(_MATRIX_X, 10, 5, 5.0, 5, horizon=3, with_p=False),
    "trace_own": detector_sql(_MATRIX_X, 10, 5, 2.0, 5, horizon=3, forecasts=f"SELECT series_id, t, k, x AS f FROM ({_MATRIX_X})", bet=lambda p: f"ln(greatest(1.5::DOUBLE - {p}, 1e-300::DOUBLE))"),
    "stream_sessions": """
        WITH flagged AS (SELECT *, "time" - lag("time") OVER w AS since FROM proximity WHERE "time" >= TIMESTAMP '2008-09-19' WINDOW w AS (PARTITION BY "user.id" ORDER BY "time")),
        numbered AS (SELECT *, sum(CASE WHEN since <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY "user.id" ORDER BY "time" ROWS UNBOUNDED PRECEDING) AS no_ FROM flagged)
        SELECT "user.id" AS user_id, min("time") AS start, max("time") + INTERVAL 30 MINUTE AS "end", count(*) AS n_events FROM numbered GROUP BY "user.id", no_""",
    "trace_sql": f"SELECT series_id, t, logm_trad, logm_hrzn, fired, fired_by FROM ({detector_sql(_MATRIX_X, 10, 5, 5.0, 5, horizon=3)})",
    "trace_modes": " UNION ALL ".join(
        f"SELECT '{name}' AS config, series_id, t, logm_trad, logm_hrzn, fired FROM ({_mode_sql(extra)})" for name, extra in MODES.items()
    ),
    "trace_graph_forecast": detector_sql(_graph_x("edges"), 10, 5, 5.0, 5, horizon=3, forecasts=_graph_x(f"({_FORECAST_EDGES})", "f", late=4)),
    "proximity_trace": "SELECT * FROM (" + detector_sql(f"SELECT series_id, t, k, round_even(x * {GRAIN}, 0) / {GRAIN} AS x FROM ({_PROXIMITY_X})", 20, 20, 20.0, 20, horizon=5, scaled=True) + ")",
    "cusum": _chart_sql("cusum") + _CHART_ROWS,
    "ewma_chart": _chart_sql("ewma") + _CHART_ROWS,
    "trials": _TRIALS + """ SELECT detector, series_id, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, round(add, 9) AS add, n_tp, n_fp, n_detections FROM trial""",
    "sweep_csv": _TRIALS + """ SELECT detector, series_id, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, round(add, 9) AS add, n_tp, n_fp, n_detections FROM trial""",
    "sweep_average": _TRIALS + _GROUPS + """ SELECT scenario, detector, round(tpr, 9) AS tpr_mean, round(fpr, 9) AS fpr_mean, round(add, 9) AS add_mean FROM cell
        UNION ALL SELECT 'AVERAGE', detector, round(avg(tpr), 9), round(avg(fpr), 9), round(avg(add), 9) FROM cell GROUP BY 2""",
    "sweep_overall": _TRIALS + _GROUPS + " SELECT detector, round(avg(tpr), 9) AS tpr, round(avg(fpr), 9) AS fpr, round(avg(add), 9) AS add FROM cell GROUP BY 1",
    "sweep_pivot": _TRIALS + """, cell AS (SELECT detector, substr(series_id, 1, 5) AS scenario, avg(tpr) AS tpr, avg(fpr) AS fpr, avg(add) AS add FROM trial GROUP BY 1, 2)
        SELECT scenario, """ + ", ".join(
        f"coalesce(max(CASE WHEN detector = '{d}' THEN printf('%.3f', {m}) END), '') AS {d}_{m}" for d in ("cusum", "ewma", "horizon", "martingale") for m in ("tpr", "fpr", "add")
    ) + " FROM cell GROUP BY 1",
    "stream_contacts": """
        WITH r AS (SELECT * FROM proximity WHERE "time" >= TIMESTAMP '2008-09-19'),
        c AS (SELECT date_diff('day', DATE '2008-09-19', CAST("time" AS DATE))::INT AS day, least("user.id", "remote.user.id.if.known") AS u,
            greatest("user.id", "remote.user.id.if.known") AS v FROM r WHERE "user.id" <> "remote.user.id.if.known")
        SELECT day, u, v, count(*) AS readings FROM c GROUP BY 1, 2, 3""",
}


