"""The engine in SQL text: scalar functions, which the optimizer inlines, and the detector as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

#: name: (parameters, result type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "clip_p": ("p DOUBLE", "DOUBLE", "if(p IS NULL, NULL, greatest(1e-10D, least(1.0D, p)))"),
    "bet_power": ("p DOUBLE, e DOUBLE", "DOUBLE", "e * pow(clip_p(p), e - 1.0D)"),
    "bet_default": ("p DOUBLE", "DOUBLE", "(bet_power(p, 0.7D) + bet_power(p, 0.8D) + bet_power(p, 0.9D)) / 3.0D"),
    "log_bet": ("g DOUBLE", "DOUBLE", "if(g IS NULL, NULL, ln(greatest(g, 1e-300D)))"),
    "theta": (
        "seed INT, series STRING, t INT, k INT",
        "DOUBLE",
        "(cast(conv(substring(md5(concat_ws('|', cast(seed AS STRING), series, cast(t AS STRING), cast(k AS STRING))), 1, 13), 16, 10) AS BIGINT) + 0.5D) / 4503599627370496.0D",
    ),
    "log_sum_exp": (
        "m ARRAY<DOUBLE>",
        "DOUBLE",
        "if(abs(array_max(m)) = double('inf'), array_max(m), array_max(m) + ln(aggregate(m, 0.0D, (a, x) -> a + exp(x - array_max(m)))))",
    ),
    "wealth_shares": (
        "m ARRAY<DOUBLE>",
        "ARRAY<DOUBLE>",
        "transform(m, x -> if(abs(array_max(m)) = double('inf'), 100.0D / size(m), 100.0D * exp(x - log_sum_exp(m))))",
    ),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions in the session; returns their names. ``prefix`` goes before each name."""
    import re

    names = "|".join(FUNCTIONS)
    for name, (parameters, kind, body) in FUNCTIONS.items():
        body = re.sub(rf"\b({names})\(", lambda m: f"{prefix}{m.group(1)}(", body)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register(f"{prefix}detect_changes", DetectChanges)
    return [prefix + n for n in (*FUNCTIONS, "detect_changes")]


@udtf(returnType="series_id string, t int, logm_trad double, logm_hrzn double, fired boolean, fired_by string")
class DetectChanges:
    """``detect_changes(TABLE(features) PARTITION BY series_id ORDER BY (t), threshold, startup_period, history_size, horizon, cooldown)``.

    The features are ``series_id STRING, t INT, x ARRAY<DOUBLE>``, a row per
    step. A series is walked step by step with the state of the stream's
    detector; nothing of it is gathered.
    """

    def __init__(self) -> None:
        self.detector = None

    def eval(self, row: Row, threshold: float = 50.0, startup_period: int = 20, history_size: int = 20, horizon: int = 5, cooldown: int = 20) -> Iterator[tuple]:
        from driftloom.operators.detector import DetectorConfig
        from driftloom.streaming.online import OnlineDetector

        x = np.asarray(row["x"], dtype=np.float64)
        if self.detector is None:
            config = DetectorConfig(threshold=float(threshold), startup_period=startup_period, history_size=history_size, horizon=horizon, cooldown=cooldown)
            self.detector = OnlineDetector(row["series_id"], config, len(x))
        trad, hrzn, _, _, fired, by = self.detector.step(x)
        yield row["series_id"], row["t"], trad, hrzn, fired, by
