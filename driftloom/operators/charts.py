"""Control charts: two-sided cumulative sums and exponentially weighted averages, any feature breaching."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from driftloom.operators.series import per_series

CHART = "score array<double>, score_max double, fired boolean, breach_k int"


@dataclass(frozen=True)
class Cusum:
    """Alarm when a one-sided sum of standardised deviations beyond ``k`` reaches ``threshold``."""

    threshold: float = 5.0
    k: float = 0.5
    startup_period: int = 20
    cooldown: int = 0


@dataclass(frozen=True)
class EwmaChart:
    """Alarm when the smoothed value lies more than ``L`` of its standard deviations from the running mean."""

    lambda_: float = 0.3
    L: float = 3.0
    startup_period: int = 20
    cooldown: int = 0

    def __post_init__(self) -> None:
        if not 0.0 < self.lambda_ <= 1.0:
            raise ValueError("lambda_ must lie in (0, 1]")


def control_chart(features: DataFrame, chart: Cusum | EwmaChart) -> DataFrame:
    """``series_id, t, score`` (per feature), ``score_max`` (null before start-up), ``fired``, ``breach_k``.

    Mean and standard deviation are those of the steps before. An alarm restarts
    the sums, or puts the smoothed value back on the running mean; its
    ``breach_k`` is the feature of the largest score, the first of equals. A
    feature that hasn't varied contributes nothing.
    """
    step = _cusum if isinstance(chart, Cusum) else _ewma
    return per_series(features, lambda names, t, x, _: step(x, chart), CHART)


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the steps before each, by updating; NaN while undefined."""
    b, steps, k = x.shape
    mean, sd = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
    m, m2 = np.zeros((b, k)), np.zeros((b, k))
    for t in range(steps):
        if t >= 1:
            mean[:, t] = m
        if t >= 2:
            sd[:, t] = np.sqrt(m2 / (t - 1))
        delta = x[:, t] - m
        m = m + delta / (t + 1)
        m2 = m2 + delta * (x[:, t] - m)
    return mean, sd


def _result(score: np.ndarray, fired: np.ndarray, known: np.ndarray) -> dict:
    top = np.where(known[None, :], score.max(axis=2), np.nan)
    return {
        "score": np.ma.array(score[None]),
        "score_max": np.ma.masked_invalid(top)[None],
        "fired": np.ma.array(fired[None]),
        "breach_k": np.ma.array(score.argmax(axis=2).astype(np.int32), mask=~fired)[None],
    }


def _cusum(x: np.ndarray, c: Cusum) -> dict:
    b, steps, k = x.shape
    mean, sd = _moments(x)
    up, down = np.zeros((b, k)), np.zeros((b, k))
    score, fired = np.zeros(x.shape), np.zeros((b, steps), dtype=bool)
    last = np.full(b, -c.cooldown - 1)
    known = np.arange(steps) >= max(c.startup_period, 2)
    for t in np.flatnonzero(known):
        z = np.where(sd[:, t] > 0, (x[:, t] - mean[:, t]) / np.where(sd[:, t] > 0, sd[:, t], 1.0), 0.0)
        up, down = np.maximum(0.0, up + z - c.k), np.maximum(0.0, down - z - c.k)
        score[:, t] = np.maximum(up, down)
        hit = fired[:, t] = (t - last > c.cooldown) & (score[:, t].max(axis=1) >= c.threshold)
        last[hit] = t
        up, down = np.where(hit[:, None], 0.0, up), np.where(hit[:, None], 0.0, down)
    return _result(score, fired, known)


def _ewma(x: np.ndarray, c: EwmaChart) -> dict:
    b, steps, k = x.shape
    mean, sd = _moments(x)
    score, fired = np.zeros(x.shape), np.zeros((b, steps), dtype=bool)
    last = np.full(b, -c.cooldown - 1)
    known = np.arange(steps) >= max(c.startup_period, 2)
    lam = c.lambda_
    z = None
    for t in np.flatnonzero(known):
        z = mean[:, t] if z is None else z
        z = lam * x[:, t] + (1.0 - lam) * z
        # Variance of a smoothed value after so many updates; an alarm doesn't restart the count.
        updates = t - c.startup_period + 1
        sigma = sd[:, t] * np.sqrt(lam / (2.0 - lam) * (1.0 - (1.0 - lam) ** (2 * updates)))
        score[:, t] = np.where(sigma > 0, np.abs(z - mean[:, t]) / np.where(sigma > 0, sigma, 1.0), 0.0)
        hit = fired[:, t] = (t - last > c.cooldown) & (score[:, t].max(axis=1) > c.L)
        last[hit] = t
        z = np.where(hit[:, None], mean[:, t], z)
    return _result(score, fired, known)
