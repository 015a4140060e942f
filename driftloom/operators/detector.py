"""Change detection by betting on conformal p-values of observed and forecast features.

Per series, in order: scores are distances from the running centroid; each
score's rank among the earlier ones is a p-value; bets on p-values multiply into
martingales, one per feature, whose sum signals a change when it reaches the
threshold. A second set of martingales bets on the scores of forecasts. An alarm
sets the wealth back to 1 but leaves centroids and earlier scores as they are,
so everything up to the bets is computed for all steps at once, and only the
wealth is folded over time.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.attribution import driver, shares
from driftloom.functions.betting import LOG_FLOOR, Bet, default
from driftloom.functions.theta import theta_value
from driftloom.operators.series import per_series

METRICS = ("euclidean", "mahalanobis", "cosine", "chebyshev")
#: Added to the diagonal of a covariance before solving.
RIDGE = 1e-6


class Forecaster(Protocol):
    """Anything that forecasts the next vector from a window (w, K)."""

    def predict_multi(self, window: np.ndarray, horizon: int) -> np.ndarray: ...


@dataclass(frozen=True)
class Ewma:
    """Exponentially weighted mean of the window, whatever the horizon."""

    alpha: float = 0.5

    def __post_init__(self) -> None:
        if not 0.0 < self.alpha < 1.0:
            raise ValueError("alpha must lie strictly between 0 and 1")

    def stack(self, windows: np.ndarray, horizon: int) -> np.ndarray:
        """Forecasts for windows (..., w, K)."""
        weights = self.alpha ** np.arange(windows.shape[-2], 0, -1)
        return np.einsum("w,...wk->...k", weights / weights.sum(), windows)

    def predict_multi(self, window: np.ndarray, horizon: int) -> np.ndarray:
        return self.stack(np.asarray(window, dtype=np.float64), horizon) if len(window) else np.zeros(np.shape(window)[1])


@dataclass(frozen=True)
class Holt:
    """Double exponential smoothing of the window, extrapolated along its trend."""

    alpha: float = 0.3
    beta: float = 0.1

    def __post_init__(self) -> None:
        if not (0.0 < self.alpha < 1.0 and 0.0 < self.beta < 1.0):
            raise ValueError("alpha and beta must lie strictly between 0 and 1")

    def stack(self, windows: np.ndarray, horizon: int) -> np.ndarray:
        """Forecasts for windows (..., w, K)."""
        if windows.shape[-2] < 2:
            return windows[..., 0, :] if windows.shape[-2] else np.zeros(windows.shape[:-2] + windows.shape[-1:])
        level, trend = windows[..., 0, :], windows[..., 1, :] - windows[..., 0, :]
        for j in range(1, windows.shape[-2]):
            last, level = level, self.alpha * windows[..., j, :] + (1.0 - self.alpha) * (level + trend)
            trend = self.beta * (level - last) + (1.0 - self.beta) * trend
        return level + horizon * trend

    def predict_multi(self, window: np.ndarray, horizon: int) -> np.ndarray:
        return self.stack(np.asarray(window, dtype=np.float64), horizon)


@dataclass(frozen=True)
class DetectorConfig:
    """Settings of a detector.

    ``rng`` chooses the tie-breaking numbers: ``hash`` (from series, step and
    feature; the same under any partitioning and in SQL) or ``pcg64`` (a numpy
    generator per series, drawn step by step, feature by feature).
    """

    threshold: float = 50.0
    horizon: int = 5
    history_size: int = 20
    betting: Bet = field(default_factory=default)
    forecaster: Forecaster = field(default_factory=Ewma)
    enable_traditional: bool = True
    enable_horizon: bool = True
    cooldown: int = 20
    rng_seed: int = 0
    rng: str = "hash"
    startup_period: int = 20
    detection_mode: str = "per_feature"
    joint_distance: str = "mahalanobis"
    normalize_features: bool = False
    horizon_weights: tuple[float, ...] | None = None

    def __post_init__(self) -> None:
        def need(holds: bool, what: str) -> None:
            if not holds:
                raise ValueError(what)

        need(self.threshold > 0, "threshold must be positive")
        need(self.enable_traditional or self.enable_horizon, "one of the two streams must be enabled")
        need(self.horizon >= 1, "horizon must be at least 1")
        need(self.history_size >= 2, "history_size must be at least 2")
        need(self.startup_period >= 0, "startup_period must not be negative")
        need(self.detection_mode in ("per_feature", "joint"), "detection_mode must be 'per_feature' or 'joint'")
        need(self.joint_distance in METRICS, f"joint_distance must be one of {METRICS}")
        need(self.rng in ("hash", "pcg64"), "rng must be 'hash' or 'pcg64'")
        if self.horizon_weights is not None:
            w = self.horizon_weights
            need(len(w) == self.horizon, f"horizon_weights has {len(w)} entries, horizon is {self.horizon}")
            need(min(w) >= 0, "horizon_weights must not be negative")
            need(abs(sum(w) - 1.0) <= 1e-8, "horizon_weights must add up to 1")


TRACE = (
    "config string, logm_trad double, logm_hrzn double, logm_pf array<double>, logm_pf_h array<double>, "
    "p array<double>, p_h array<double>, fired boolean, fired_by string"
)


def detect(features: DataFrame, config: DetectorConfig | None = None, ahead: DataFrame | None = None, **settings) -> DataFrame:
    """The trace of one detector over every series of ``series_id, t, x``.

    Returns ``series_id, t, logm_trad, logm_hrzn`` (log of the summed wealth of
    observed and of forecast scores; null while off or warming up), ``logm_pf,
    logm_pf_h`` (per feature, before an alarm's reset), ``p, p_h`` (null
    elements where undefined), ``fired, fired_by``. ``ahead`` may bring
    forecasts of its own, as vectors ``x`` by series and step, in place of the
    configured forecaster's.

    Steps are taken in order of t, one row per step, whatever gaps t has; use
    ``clean_features`` on rows that repeat or have nulls. A series is one task's
    work; its length is its number of steps, not of raw events.
    """
    if config is not None and settings:
        raise TypeError("give either a config or settings, not both")
    return detect_many(features, {"": config or DetectorConfig(**settings)}, ahead).drop("config")


def detect_many(features: DataFrame, configs: Mapping[str, DetectorConfig], ahead: DataFrame | None = None) -> DataFrame:
    """The traces of several detectors, told apart by ``config``; the features are read and gathered once for all."""
    named = dict(configs)

    def kernel(series: list, t: np.ndarray, x: np.ndarray, guess: np.ndarray | None) -> dict:
        made: dict = {}
        traces = [trace(series, x, c, guess, made) for c in named.values()]
        out = {"config": np.broadcast_to(np.array(list(named), dtype=object)[:, None, None], (len(named), *t.shape))}
        return out | {key: np.ma.stack([tr[key] for tr in traces]) for key in traces[0]}

    return per_series(features, kernel, TRACE, ahead)


def distances(x: np.ndarray, points: np.ndarray, past: int, metric: str) -> np.ndarray:
    """Distance of ``points[:, t]`` from the rows ``x[:, : t + past]`` of a stack, for every t.

    ``past`` is 0 to leave out row t, 1 to count it in. Where there is no row
    yet the distance is 0; covariances of fewer than two rows, and zero vectors
    under the cosine, fall back to the Euclidean distance.
    """
    b, steps, k = x.shape
    n = np.arange(steps) + past
    sums = np.concatenate([np.zeros((b, 1, k)), np.cumsum(x, axis=1)], axis=1)
    center = sums[:, n] / np.maximum(n, 1)[None, :, None]
    diff = points - center
    euclid = np.sqrt((diff**2).sum(axis=2))
    if metric == "euclidean":
        out = euclid
    elif metric == "chebyshev":
        out = np.abs(diff).max(axis=2)
    elif metric == "cosine":
        scale = np.sqrt((points**2).sum(axis=2)) * np.sqrt((center**2).sum(axis=2))
        out = np.where(scale > 0, 1.0 - (points * center).sum(axis=2) / np.where(scale > 0, scale, 1.0), euclid)
    elif metric == "mahalanobis":
        # Moments about the series' mean lose less to cancellation than moments about 0.
        y = x - x.mean(axis=1, keepdims=True)
        first = np.concatenate([np.zeros((b, 1, k)), np.cumsum(y, axis=1)], axis=1)[:, n]
        second = np.concatenate([np.zeros((b, 1, k, k)), np.cumsum(y[:, :, :, None] * y[:, :, None, :], axis=1)], axis=1)[:, n]
        count = np.maximum(n, 2)[None, :, None, None]
        cov = (second - first[:, :, :, None] * first[:, :, None, :] / count) / (count - 1) + RIDGE * np.eye(k)
        form = (diff * np.linalg.solve(cov, diff[..., None])[..., 0]).sum(axis=2)
        out = np.where(n[None, :] >= 2, np.sqrt(np.maximum(form, 0.0)), euclid)
    else:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS} is expected")
    return np.where(n[None, :] >= 1, out, 0.0)


#: Steps of a block within which scores are compared one by one.
RANK_BLOCK = 64


def ranks(pool: np.ndarray, points: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``pool[:, start:t]`` are above and equal to ``points[:, t]``, for all t; arrays (B, T, ...).

    NaN compares with nothing. Steps are compared with each other within blocks;
    then blocks are joined two by two, each later half being placed in the sorted
    earlier half: the same counts in T log T steps whatever the length.
    """
    shape = points.shape
    b, steps = shape[:2]
    above, equal = np.zeros((b, steps, math.prod(shape[2:]))), np.zeros((b, steps, math.prod(shape[2:])))
    late = np.maximum(steps - start, 0)
    if not late or not above.size:
        return above.reshape(shape), equal.reshape(shape)
    # Series last and padded to whole blocks; a padded or undefined score is below everything.
    size = RANK_BLOCK * 2 ** max(0, math.ceil(math.log2(late / RANK_BLOCK)))
    line = lambda x: np.moveaxis(x.reshape(b, steps, -1)[:, start:], 1, 2).reshape(-1, late)
    seen, now = np.full((above.size // steps, size), -np.inf), np.full((above.size // steps, size), np.nan)
    seen[:, :late], now[:, :late] = line(pool), line(points)
    seen[np.isnan(seen)] = -np.inf
    gt, ge = np.zeros(seen.shape, dtype=np.int64), np.zeros(seen.shape, dtype=np.int64)
    blocks = (len(seen), size // RANK_BLOCK, RANK_BLOCK)
    s, p, in_gt, in_ge = (x.reshape(blocks) for x in (seen, now, gt, ge))
    for j in range(RANK_BLOCK - 1):
        in_gt[:, :, j + 1 :] += s[:, :, j, None] > p[:, :, j + 1 :]
        in_ge[:, :, j + 1 :] += s[:, :, j, None] >= p[:, :, j + 1 :]
    half = RANK_BLOCK
    while half < size:
        s, p, in_gt, in_ge = (x.reshape(-1, 2, half) for x in (seen, now, gt, ge))
        early, later = s[:, 0], p[:, 1]
        defined = ~np.isnan(later)
        in_gt[:, 1] += np.where(defined, half - _placed(early, later, True), 0)
        in_ge[:, 1] += np.where(defined, half - _placed(early, later, False), 0)
        half *= 2
    back = lambda x: np.moveaxis(x[:, :late].reshape(b, -1, late), 2, 1)
    above[:, start:], equal[:, start:] = back(gt), back(ge - gt)
    # What is undefined isn't equal to minus infinity.
    lowest = np.isneginf(points.reshape(above.shape))
    if lowest.any():
        undefined = np.isnan(pool.reshape(above.shape))
        undefined[:, :start] = False
        equal -= np.where(lowest, np.cumsum(undefined, axis=1) - undefined, 0)
    return above.reshape(shape), equal.reshape(shape)


def _placed(early: np.ndarray, later: np.ndarray, ties: bool) -> np.ndarray:
    """How many of a row of ``early`` are below each of the same row of ``later``, or with ``ties`` not above it."""
    half = early.shape[1]
    order = np.argsort(np.concatenate([early, later] if ties else [later, early], axis=1), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.cumsum((order < half) == ties, axis=1), axis=1)
    return place[:, half:] if ties else place[:, :half]


def _thetas(series: list, cfg: DetectorConfig, steps: int, k: int, made: dict) -> np.ndarray:
    """Tie-breaking numbers (B, T, K) or, in joint mode, (B, T, K + 1); hashed ones are computed once for all configurations of a stack."""
    wide = k + (cfg.detection_mode == "joint")
    if cfg.rng == "pcg64":
        out = np.zeros((len(series), steps, wide))
        draws = max(0, steps - cfg.startup_period)
        out[:, steps - draws :] = np.random.default_rng(cfg.rng_seed).uniform(size=(draws, wide))
        return out
    if cfg.rng_seed not in made:
        made[cfg.rng_seed] = np.array([[[theta_value(cfg.rng_seed, name, t, j) for j in range(k + 1)] for t in range(steps)] for name in series])
    return made[cfg.rng_seed].reshape(len(series), steps, k + 1)[:, :, :wide]


def _forecasts(x: np.ndarray, cfg: DetectorConfig, horizon: int, guess: np.ndarray | None) -> np.ndarray:
    """Forecasts (B, T, K) made at each step; NaN before the window is full."""
    w = cfg.history_size
    out = np.full(x.shape, np.nan)
    if x.shape[1] <= w:
        return out
    if guess is not None:
        out[:, w:] = guess[:, w:]
        return out
    windows = np.lib.stride_tricks.sliding_window_view(x, w, axis=1)[:, 1:].swapaxes(2, 3)
    if hasattr(cfg.forecaster, "stack"):
        out[:, w:] = cfg.forecaster.stack(windows, horizon)
    else:
        for b in range(x.shape[0]):
            for j in range(windows.shape[1]):
                out[b, w + j] = cfg.forecaster.predict_multi(windows[b, j], horizon)
    return out


def _lse(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(values - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def trace(series: list, x: np.ndarray, cfg: DetectorConfig, guess: np.ndarray | None = None, made: dict | None = None) -> dict:
    """The detector's trace of a stack of series (B, T, K); ``made`` keeps numbers that several configurations share."""
    b, steps, k = x.shape
    s0, w = cfg.startup_period, cfg.history_size
    joint = cfg.detection_mode == "joint"
    if cfg.normalize_features and s0 >= 5 and steps >= 2:
        first = x[:, :s0]
        sd = first.std(axis=1, ddof=1, keepdims=True) if first.shape[1] > 1 else np.ones((b, 1, k))
        x = (x - first.mean(axis=1, keepdims=True)) / np.where(sd < 1e-10, 1.0, sd)
    log_bet = lambda p: np.log(np.maximum(cfg.betting.array(p), 1e-300))

    # Before the fold: scores, p-values and bets of all steps.
    n = np.maximum(np.arange(steps) - s0, 0).astype(np.float64)
    sums = np.concatenate([np.zeros((b, 1, k)), np.cumsum(x, axis=1)], axis=1)
    with np.errstate(invalid="ignore"):
        score = np.abs(x - sums[:, :steps] / np.where(np.arange(steps) > 0, np.arange(steps), np.nan)[None, :, None])
    center = sums[:, 1:] / np.arange(1, steps + 1)[None, :, None]
    theta = _thetas(series, cfg, steps, k, {} if made is None else made)
    above, equal = ranks(score, score, s0)
    empty = (n == 0)[None, :, None]
    p = np.where(empty, 1.0, (above + theta[:, :, :k] * (1.0 + equal)) / (n[None, :, None] + 1.0))
    bets = log_bet(p)
    if joint:
        jscore = distances(x, x, 0, cfg.joint_distance)
        ja, je = ranks(jscore, jscore, s0)
        jbets = log_bet(np.where(n[None, :] == 0, 1.0, (ja + theta[:, :, k] * (1.0 + je)) / (n + 1.0)))
    ahead = cfg.enable_horizon and steps > w
    mixing = cfg.horizon_weights is not None
    horizons = list(range(1, cfg.horizon + 1)) if mixing else [cfg.horizon]
    first_ahead = max(s0, w)
    bets_h: list[np.ndarray] = []
    p_h = np.full(x.shape, np.nan)
    jbets_h = np.zeros((b, steps))
    if ahead:
        for h in horizons:
            forecast = _forecasts(x, cfg, h, guess)
            a, e = ranks(score, np.abs(forecast - center), s0)
            p_h = (a + e + 1.0) / (n[None, :, None] + 1.0)
            bets_h.append(log_bet(p_h))
        if joint:
            a, e = ranks(jscore, distances(x, forecast, 1, cfg.joint_distance), s0)
            jbets_h = log_bet((a + e + 1.0) / (n + 1.0))

    # The fold: wealth, alarms, resets.
    with np.errstate(divide="ignore"):
        log_w = np.log(np.array(cfg.horizon_weights))[:, None, None] if mixing else None
    trad, hrzn = np.zeros((b, k)), np.zeros((b, k))
    per_h = np.zeros((len(horizons), b, k))
    jtrad, jhrzn = np.zeros(b), np.zeros(b)
    last = np.full(b, -cfg.cooldown - 1)
    level = np.log(cfg.threshold)
    out_trad, out_hrzn = np.zeros((b, steps, k)), np.zeros((b, steps, k))
    sum_trad, sum_hrzn = np.full((b, steps), np.nan), np.full((b, steps), np.nan)
    fired = np.zeros((b, steps), dtype=bool)
    by_trad = np.zeros((b, steps), dtype=bool)
    for t in range(s0, steps):
        if cfg.enable_traditional:
            trad = np.maximum(trad + bets[:, t], LOG_FLOOR)
            if joint:
                jtrad = np.maximum(jtrad + jbets[:, t], LOG_FLOOR)
            sum_trad[:, t] = jtrad if joint else _lse(trad, 1)
        if ahead and t >= first_ahead:
            for i, bh in enumerate(bets_h):
                per_h[i] = np.maximum(per_h[i] + bh[:, t], LOG_FLOOR)
            hrzn = _lse(per_h + log_w, 0) if mixing else per_h[0].copy()
            if joint:
                jhrzn = np.maximum(jhrzn + jbets_h[:, t], LOG_FLOOR)
            sum_hrzn[:, t] = jhrzn if joint else _lse(hrzn, 1)
        out_trad[:, t], out_hrzn[:, t] = trad, hrzn
        ready = t - last > cfg.cooldown
        with np.errstate(invalid="ignore"):
            by_trad[:, t] = ready & (sum_trad[:, t] >= level)
            fired[:, t] = by_trad[:, t] | (ready & (sum_hrzn[:, t] >= level))
        hit = fired[:, t]
        if hit.any():
            last[hit] = t
            trad, hrzn = np.where(hit[:, None], 0.0, trad), np.where(hit[:, None], 0.0, hrzn)
            per_h[:, hit] = 0.0
            jtrad, jhrzn = np.where(hit, 0.0, jtrad), np.where(hit, 0.0, jhrzn)
        trad, hrzn = np.maximum(trad, LOG_FLOOR), np.maximum(hrzn, LOG_FLOOR)

    early = np.broadcast_to((np.arange(steps) < s0)[None, :, None], x.shape)
    early_h = np.broadcast_to((np.arange(steps) < first_ahead)[None, :, None] | (not ahead), x.shape)
    names = np.where(by_trad, "traditional", "horizon").astype(object)
    return {
        "logm_trad": np.ma.masked_invalid(sum_trad),
        "logm_hrzn": np.ma.masked_invalid(sum_hrzn),
        "logm_pf": np.ma.array(out_trad),
        "logm_pf_h": np.ma.array(out_hrzn),
        "p": np.ma.array(p, mask=early),
        "p_h": np.ma.array(p_h, mask=early_h),
        "fired": np.ma.array(fired),
        "fired_by": np.ma.array(names, mask=~fired),
    }


def detections(traces: DataFrame, feature_names: list[str] | None = None) -> DataFrame:
    """The alarms of a trace: ``series_id, t, fired_by, driver`` (index, or name if given) and ``driver_pct``, from the stream that fired."""
    logm = F.when(F.col("fired_by") == "horizon", F.col("logm_pf_h")).otherwise(F.col("logm_pf"))
    keys = [c for c in ("config", "series_id", "t", "fired_by") if c in traces.columns]
    out = traces.filter("fired").select(*keys, driver(logm).alias("driver"), F.array_max(shares(logm)).alias("driver_pct"))
    if feature_names:
        out = out.withColumn("driver", F.get(F.array(*[F.lit(n) for n in feature_names]), F.col("driver")))
    return out


def scores(features: DataFrame, seed: int = 0) -> DataFrame:
    """``series_id, t, c, s, p``: centroid of the steps before, distance from it, and its smoothed conformal p-value, per feature.

    The same as the window expressions give, in a form for series of any length:
    scores before are never gathered per step. ``c`` and ``p`` are null at the
    first step, where ``s`` is 0.
    """

    def kernel(series: list, t: np.ndarray, x: np.ndarray, _: np.ndarray | None) -> dict:
        b, steps, k = x.shape
        n = np.arange(steps)[None, :, None]
        center = (np.cumsum(x, axis=1) - x) / np.maximum(n, 1)
        score = np.where(n > 0, np.abs(x - center), 0.0)
        above, equal = ranks(score, score, 0)
        theta = np.array([[[theta_value(seed, name, int(step), j) for j in range(k)] for step in row] for name, row in zip(series, t)])
        first = np.broadcast_to(n == 0, x.shape)
        p = (above + theta * (1.0 + equal)) / (n + 1.0)
        return {"c": np.ma.array(center, mask=first)[None], "s": np.ma.array(score)[None], "p": np.ma.array(p, mask=first)[None]}

    return per_series(features, kernel, "c array<double>, s array<double>, p array<double>")


def joint_scores(features: DataFrame, metric: str = "mahalanobis") -> DataFrame:
    """``series_id, t, s``: distance of each step's vector from the steps before; 0 at the first."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS} is expected")
    return per_series(features, lambda names, t, x, _: {"s": np.ma.array(distances(x, x, 0, metric)[None])}, "s double")


__all__ = ["DetectorConfig", "Ewma", "Holt", "Forecaster", "detect", "detect_many", "detections", "joint_scores", "scores", "distances", "ranks", "replace", "trace"]
