"""One object per detector, one lazy result per run."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.attribution import shares, wealth
from driftloom.operators.detector import DetectorConfig, Ewma, detect, detections
from driftloom.operators.graph_forecast import GraphForecast, forecast_features
from driftloom.operators.graphs import DEFAULT, Feature, extract, names
from driftloom.operators.metrics import evaluate


@dataclass(frozen=True)
class Result:
    """What a run gives; every part is a lazy frame over all series."""

    config: DetectorConfig
    feature_names: list[str] | None
    features: DataFrame
    trace: DataFrame

    @property
    def change_points(self) -> DataFrame:
        """``series_id, t, fired_by, driver, driver_pct`` of the alarms."""
        return detections(self.trace, self.feature_names)

    @property
    def wealth(self) -> DataFrame:
        """``series_id, t, m_traditional, m_horizon``: the summed wealth on the linear scale."""
        return self.trace.select("series_id", "t", wealth(F.col("logm_trad")).alias("m_traditional"), wealth(F.col("logm_hrzn")).alias("m_horizon"))

    def attribution(self, stream: str = "traditional") -> DataFrame:
        """``series_id, t, feature, pct``: each step's shares of a stream; zeros where there is nothing to divide."""
        if stream not in ("traditional", "horizon"):
            raise ValueError("stream must be 'traditional' or 'horizon'")
        logm = F.col("logm_pf" if stream == "traditional" else "logm_pf_h")
        rows = self.trace.select("series_id", "t", F.posexplode(shares(logm, "zero")).alias("k", "pct"))
        return rows.select("series_id", "t", self._name(F.col("k")).alias("feature"), "pct")

    def score(self, truth: DataFrame, delta: int = 20) -> DataFrame:
        """How the alarms match ``truth`` (``series_id, cp``), per series."""
        lengths = self.features.groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("steps"))
        return evaluate(lengths, self.trace.filter("fired").select("series_id", "t"), truth, ["series_id"], delta)

    def _name(self, k: Column) -> Column:
        return F.get(F.array(*[F.lit(n) for n in self.feature_names]), k) if self.feature_names else k.cast("string")


class Detector:
    """A configured detector; give either a config or its settings.

    A ``GraphForecast`` as forecaster forecasts graphs and takes their features,
    so it needs ``run`` with the graphs themselves.
    """

    def __init__(self, config: DetectorConfig | None = None, **settings: object) -> None:
        if config is not None and settings:
            raise TypeError("give either a config or settings, not both")
        self.config = config or DetectorConfig(**settings)

    def run(self, snapshots: DataFrame, edges: DataFrame, features: tuple[Feature, ...] = DEFAULT) -> Result:
        """Extract features from graph snapshots and watch them."""
        x = extract(snapshots, edges, features)
        ahead, config = None, self.config
        if isinstance(config.forecaster, GraphForecast):
            ahead = forecast_features(snapshots, edges, config.forecaster, features)
            config = replace(config, forecaster=Ewma())
        return Result(self.config, names(features), x, detect(x, config, ahead))

    def run_on_features(self, features: DataFrame, feature_names: list[str] | None = None) -> Result:
        """Watch feature vectors ``series_id, t, x``."""
        if isinstance(self.config.forecaster, GraphForecast):
            raise ValueError("a forecaster of graphs needs the graphs: use run()")
        return Result(self.config, feature_names, features, detect(features, self.config))
