"""Irregular readings onto a regular grid, gaps filled by singular-spectrum imputation.

Readings are first counted and averaged per (key, period), combined on the map
side, so neither a busy key nor a busy period loads one task. What is left of a
key is bounded by the number of periods it was seen in; those few rows become
one array per key, and the imputation runs over batches of such arrays in Arrow.

The imputation (iterative SSA): embed each series in a Hankel trajectory matrix,
cut the singular directions below a threshold and shrink the others by it,
average the anti-diagonals back into a series, put those values into the missing
places only, and repeat until the missing values stop moving. Shrinking instead
of keeping a fixed number of directions makes a step the proximal map of a convex
problem; with a little ridge it brings any two estimates nearer to each other by
the factor ``1 / (1 + ridge)``, so the iteration settles from anywhere, and after
how many steps is known beforehand.

How much of a series is structure is asked of the series itself: each threshold
is tried on known periods hidden in turns, and unless one is clearly better
there than the series' level, the level is the estimate. The level is the mean
of the known values, drawn toward the mean over all series in so far as few and
noisy values make it uncertain (a random-effects estimate; five sums over all
series are all that it needs).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.times import micros
from driftloom.session import cut, width

#: Working memory of one stack of trajectory matrices, in bytes.
STACK_BYTES = 32_000_000
#: Rows of one output batch.
BATCH_ROWS = 200_000
#: Turns in which known periods are hidden.
FOLDS = 4


@dataclass(frozen=True)
class GridSpec:
    """Column names and parameters of :func:`regular_grid`.

    ``thresholds`` are tried in units of the largest singular value that noise
    of the series' spread would have. ``longest_gap`` is the largest number of
    missing periods that are estimated from both sides: longer gaps are marked
    only, and the series before and after are series of their own.
    ``longest_piece`` bounds the working memory in the same way: a series
    without such gaps is cut after so many periods.
    """

    keys: tuple[str, ...]
    time: str
    value: str
    origin: str
    period_seconds: int = 86_400
    window: int = 14
    thresholds: tuple[float, ...] = (0.02, 0.1, 0.35)
    ridge: float = 0.004
    tolerance: float = 1e-4
    least_known: int = 12
    longest_gap: int = 1_000
    longest_piece: int = 50_000

    def __post_init__(self) -> None:
        if not self.keys:
            raise ValueError("at least one key is needed")
        if self.period_seconds < 1 or self.window < 2 or self.least_known < 3 or self.longest_gap < 1 or self.longest_piece < 1:
            raise ValueError("period_seconds, window, least_known, longest_gap or longest_piece is out of range")
        if self.ridge <= 0 or self.tolerance <= 0 or not self.thresholds or min(self.thresholds) <= 0:
            raise ValueError("ridge, tolerance and thresholds must be positive")


@dataclass(frozen=True)
class Levels:
    """What all series tell about one: their mean, the variance within them and between them."""

    mean: float
    within: float
    between: float

    def of(self, n: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """The level of series with ``n`` known values of mean ``mean``."""
        noise = self.within / np.maximum(n, 1)
        total = self.between + noise
        return np.where(total > 0, (self.between * mean + noise * self.mean) / np.where(total > 0, total, 1.0), mean)


def regular_grid(readings: DataFrame, spec: GridSpec) -> DataFrame:
    """One row per key and period from the first to the last period with a reading.

    Returns ``key_0.., period, filled, n_readings, readings_est, value,
    value_filled, converged, iterations``. ``period`` counts from ``origin``. ``n_readings`` is what was
    seen (0 in a filled period), ``readings_est`` that number or, where
    ``filled``, its imputed estimate, between 0 and the most that the key had in
    a period; ``value`` is the period's mean or, where ``value_filled``, its
    imputed estimate, between the least and the largest of the key's means.
    ``converged`` and ``iterations`` are the same in all rows of a series:
    whether both estimates stood still within the tolerance, and after how many
    steps the later of them did (0 if no structure was found, so that the level
    is the estimate). In gaps of more than ``longest_gap`` periods both
    estimates are null.

    Defined cases: readings without a time or before ``origin`` aren't on the
    grid; a null key is a key of its own; values that are NaN or infinite count
    as null; a period whose values are all null isn't filled but its value is
    imputed; a series without any value has null values; a constant or short
    series is filled with its level; repeated readings count each; an empty
    table yields no row; other columns, whatever their names, are ignored.
    """
    period = spec.period_seconds * 1_000_000
    start = micros(F.lit(spec.origin).cast("timestamp_ntz"))
    names = [f"key_{i}" for i in range(len(spec.keys))]
    value = F.col(spec.value).cast("double")
    rows = readings.select(
        *[F.col(k).alias(n) for k, n in zip(spec.keys, names)],
        F.floor((micros(F.col(spec.time)) - start) / F.lit(period)).cast("int").alias("period"),
        F.when(F.abs(value) < float("inf"), value).alias("v"),
    ).filter(F.col("period") >= 0)
    per_period = rows.groupBy(*names, "period").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v"))
    # The imputation is work per key, not per byte: a fixed number of tasks keeps the few bytes from being merged into one.
    spread = per_period.repartition(width(readings.sparkSession), *names)
    moments = lambda c, to: [F.count(c).alias(f"{to}_n"), F.avg(c).alias(f"{to}_m"), F.var_pop(c).alias(f"{to}_s")]
    series = spread.groupBy(*names).agg(
        F.array_sort(F.collect_list(F.struct("period", "n", "v"))).alias("seen"), *moments(F.log1p("n"), "n"), *moments(F.col("v"), "v")
    )
    series = cut(
        series.select(
            *names, F.col("seen.period").alias("period"), F.col("seen.n").alias("n"), F.col("seen.v").alias("v"), *[f"{c}_{m}" for c in "nv" for m in "nms"]
        )
    )
    levels = tuple(_levels(series, c) for c in "nv")
    series = series.select(*names, "period", "n", "v")

    schema = T.StructType(
        [series.schema[n] for n in names]
        + [
            T.StructField("period", T.IntegerType()),
            T.StructField("filled", T.BooleanType()),
            T.StructField("n_readings", T.LongType()),
            T.StructField("readings_est", T.DoubleType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("value_filled", T.BooleanType()),
            T.StructField("converged", T.BooleanType()),
            T.StructField("iterations", T.IntegerType()),
        ]
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _densify(batch, names, spec, levels)

    return series.mapInArrow(fill, schema)


def _levels(series: DataFrame, c: str) -> Levels:
    """The moments over all series of the known values ``c`` (one row comes to the driver)."""
    n, m, s = (F.col(f"{c}_{x}") for x in "nms")
    total, mean, squares, inner, keys, n2 = series.filter(n > 0).agg(
        F.sum(n), F.sum(n * m) / F.sum(n), F.sum(n * m * m), F.sum(n * s), F.count(n), F.sum(n.cast("double") * n)
    ).first()
    if not total:
        return Levels(0.0, 0.0, 0.0)
    within = inner / max(total - keys, 1)
    room = total - n2 / total
    between = (squares - total * mean * mean - (keys - 1) * within) / room if room > 0 else 0.0
    return Levels(mean, within, max(between, 0.0))


def _densify(batch: pa.RecordBatch, names: list[str], spec: GridSpec, levels: tuple[Levels, Levels]) -> Iterator[pa.RecordBatch]:
    """The grid rows of a batch of series."""
    period, n, v = (batch.column(batch.schema.get_field_index(c)) for c in ("period", "n", "v"))
    sizes = np.asarray(pc.list_value_length(period))
    seen = period.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = n.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(batch.num_rows), sizes)

    # Where a series begins, goes on after a long gap, or is cut for its length.
    step = np.diff(seen, prepend=0)
    new = np.diff(owner, prepend=-1) > 0
    apart = new | (step > spec.longest_gap + 1)
    since = seen - seen[np.maximum.accumulate(np.where(apart, np.arange(len(seen)), 0))]
    opens = np.flatnonzero(apart | (np.diff(since // spec.longest_piece, prepend=0) > 0))
    first = seen[opens]
    closes = np.append(opens[1:], len(seen)) - 1
    follows = np.append(~apart[opens[1:]], False)
    last = np.where(follows, np.append(first[1:], 0) - 1, seen[closes])
    spans = last - first + 1
    piece = np.cumsum(np.isin(np.arange(len(seen)), opens)) - 1

    how = (spec.window, spec.thresholds, spec.ridge, spec.tolerance, spec.least_known)
    made = ["period", "filled", "n_readings", "readings_est", "value", "value_filled", "converged", "iterations"]
    keys = [batch.column(batch.schema.get_field_index(k)) for k in names]
    of_group = (np.cumsum(spans) - spans) // BATCH_ROWS
    for g in np.unique(of_group):
        chosen = np.flatnonzero(of_group == g)
        inside = (piece >= chosen[0]) & (piece <= chosen[-1])
        length = spans[chosen]
        starts = np.cumsum(length) - length
        place = seen[inside] + (starts - first[chosen])[piece[inside] - chosen[0]]
        total = int(length.sum())
        n_all, v_all = np.full(total, np.nan), np.full(total, np.nan)
        n_all[place], v_all[place] = counts[inside], values[inside]
        filled, unvalued = np.isnan(n_all), np.isnan(v_all)
        # Counts are skewed and mustn't turn negative: they are imputed on a log scale.
        n_est, n_steps, n_settled = impute_marked(np.log1p(n_all), length, levels[0], *how, floor=0.0)
        v_est, v_steps, v_settled = impute_marked(v_all, length, levels[1], *how)
        row = np.repeat(owner[opens[chosen]], length)
        yield pa.RecordBatch.from_arrays(
            [
                *[k.take(pa.array(row)) for k in keys],
                pa.array((np.arange(total) - np.repeat(starts - first[chosen], length)).astype(np.int32)),
                pa.array(filled),
                pa.array(np.where(filled, 0, n_all).astype(np.int64)),
                pa.array(np.where(filled, np.expm1(n_est), n_all)),
                pa.array(v_est, mask=np.isnan(v_est)),
                pa.array(unvalued),
                pa.array(np.repeat(n_settled & v_settled, length)),
                pa.array(np.repeat(np.maximum(n_steps, v_steps), length).astype(np.int32)),
            ],
            names=[*names, *made],
        )

    for at in np.flatnonzero(apart & ~new):
        for low in range(int(seen[at - 1]) + 1, int(seen[at]), BATCH_ROWS):
            days = np.arange(low, min(low + BATCH_ROWS, int(seen[at])), dtype=np.int32)
            m, nothing = len(days), pa.nulls(len(days), pa.float64())
            yes = pa.array(np.ones(m, dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [*[k.take(pa.array(np.full(m, owner[at]))) for k in keys], pa.array(days), yes, pa.array(np.zeros(m, np.int64)), nothing, nothing, yes, yes, pa.array(np.zeros(m, np.int32))],
                names=[*names, *made],
            )


def impute_marked(
    flat: np.ndarray, spans: np.ndarray, levels: Levels, window: int, thresholds: tuple[float, ...], ridge: float, tolerance: float, least_known: int, floor: float | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``flat`` holds series of the lengths ``spans`` one after another, NaN where missing; the same, filled, with each series' steps and whether it settled.

    A series without a value stays NaN; known values are returned unchanged.
    Estimates lie between the series' least value (or ``floor``) and its largest.
    """
    out = flat.copy()
    settled = np.ones(len(spans), dtype=bool)
    steps = np.zeros(len(spans), dtype=np.int64)
    ends = np.cumsum(spans)
    lags = np.minimum(window, spans // 2)
    gaps = np.add.reduceat(np.isnan(flat), ends - spans) if len(spans) else np.zeros(0)
    order = np.lexsort((spans, lags))
    order = order[gaps[order] > 0]
    for lag in np.unique(lags[order]):
        alike = order[lags[order] == lag]
        # Sorted by length: a group's last is its longest. Each series is tried with all thresholds and turns at once.
        copies = max(int(lag), 1) * 8 * 4 * FOLDS * len(thresholds)
        while len(alike):
            most = max(1, int(np.searchsorted(spans[alike] * np.arange(1, len(alike) + 1) * copies, STACK_BYTES, side="right")))
            group, alike = alike[:most], alike[most:]
            longest = int(spans[group].max())
            inside = np.arange(longest)[None, :] < spans[group][:, None]
            index = np.minimum((ends - spans)[group][:, None] + np.arange(longest)[None, :], len(flat) - 1)
            x = np.where(inside, flat[index], 0.0)
            missing = np.isnan(x)
            known = inside & ~missing
            n_known = known.sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                level = levels.of(n_known, np.where(known, x, 0.0).sum(axis=1) / n_known)
            spread = np.sqrt(np.where(known, (x - level[:, None]) ** 2, 0.0).sum(axis=1) / np.maximum(n_known, 1))
            x = np.where(missing, np.where(n_known > 0, level, np.nan)[:, None], x)
            tried = np.flatnonzero((n_known >= least_known) & (spread > 1e-12)) if lag >= 2 else np.zeros(0, dtype=int)
            if len(tried):
                z = np.where(known[tried], (x[tried] - level[tried, None]) / spread[tried, None], 0.0)
                noise = np.sqrt(spans[group][tried] - lag + 1.0) + math.sqrt(lag)
                best = _choose(z, known[tried], spans[group][tried], int(lag), noise, thresholds, ridge, tolerance)
                has = np.flatnonzero(best > 0)
                if len(has):
                    of = tried[has]
                    z, used, stood = _iterate(z[has], missing[of], spans[group][of], int(lag), best[has] * noise[has], ridge, tolerance)
                    x[of] = np.where(missing[of], z * spread[of, None] + level[of, None], x[of])
                    steps[group[of]], settled[group[of]] = used, stood
            low = np.where(known, x, np.inf).min(axis=1) if floor is None else np.full(len(group), floor)
            high = np.where(known, x, -np.inf).max(axis=1)
            x = np.where(missing & (n_known > 0)[:, None], np.clip(x, low[:, None], high[:, None]), x)
            out[index[missing]] = x[missing]
    return out, steps, settled


def _choose(z: np.ndarray, known: np.ndarray, spans: np.ndarray, lag: int, noise: np.ndarray, thresholds: tuple[float, ...], ridge: float, tolerance: float) -> np.ndarray:
    """For each series the threshold that restores hidden known values best, 0 if none beats the level by two standard errors."""
    turn = (np.cumsum(known, axis=1) - 1) % FOLDS
    n = known.sum(axis=1)
    hidden = np.stack([known & (turn == f) for f in range(FOLDS)], axis=1)
    start = np.where(hidden, 0.0, z[:, None, :])
    gain, error = np.zeros((len(z), len(thresholds))), np.zeros((len(z), len(thresholds)))
    b, _, longest = hidden.shape
    flat, gaps, lengths = start.reshape(b * FOLDS, longest), (~known[:, None, :] | hidden).reshape(b * FOLDS, longest), np.repeat(spans, FOLDS)
    gaps = gaps & (np.arange(longest)[None, :] < lengths[:, None])
    c = len(thresholds)
    cuts = np.concatenate([np.repeat(t * noise, FOLDS) for t in thresholds])
    # A coarser tolerance is enough to tell the thresholds apart.
    guess, _, _ = _iterate(np.tile(flat, (c, 1)), np.tile(gaps, (c, 1)), np.tile(lengths, c), lag, cuts, ridge, max(tolerance, 1e-2))
    guess = guess.reshape(c, b, FOLDS, longest)
    for k in range(c):
        better = np.where(hidden, z[:, None, :] ** 2 - (guess[k] - z[:, None, :]) ** 2, 0.0)
        gain[:, k] = better.sum(axis=(1, 2)) / n
        error[:, k] = np.sqrt(np.maximum((better**2).sum(axis=(1, 2)) / n - gain[:, k] ** 2, 0.0) / n)
    gain = np.where(gain > 2.0 * error, gain, 0.0)
    best = gain.argmax(axis=1)
    return np.where(gain[np.arange(b), best] > 0, np.array(thresholds)[best], 0.0)


def _iterate(
    z: np.ndarray, missing: np.ndarray, spans: np.ndarray, lag: int, cuts: np.ndarray, ridge: float, tolerance: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The SSA iteration over a stack of standardised, zero-padded series: the series, steps used, and whether each settled.

    In the norm of the trajectory matrix a step is a contraction by ``1 / (1 + ridge)``, which bounds the steps needed.
    """
    width = z.shape[1]
    rows = width - lag + 1
    valid = np.arange(rows)[None, :] < (spans - lag + 1)[:, None]
    place = np.arange(width)[None, :]
    cover = np.minimum.reduce([place + 1 + 0 * spans[:, None], np.full((len(z), width), lag), spans[:, None] - place, 0 * place + (spans - lag + 1)[:, None]])
    cover = np.maximum(cover, 1)
    active = np.arange(len(z))
    z = z.copy()
    used = np.zeros(len(z), dtype=np.int64)
    current, gaps, inside, weight = z, missing, valid[:, :, None].astype(float), 1.0 / cover
    size = np.sqrt((cover * z**2).sum(axis=1)).max() if len(z) else 0.0
    most = math.ceil(math.log(max(2.0 * size / tolerance, 2.0)) / math.log1p(ridge)) + 1
    for _ in range(most):
        hankel = np.lib.stride_tricks.sliding_window_view(current, lag, axis=1) * inside
        squares, vectors = np.linalg.eigh(hankel.transpose(0, 2, 1) @ hankel)
        singular = np.sqrt(np.maximum(squares, 1e-30))
        kept = np.maximum(1.0 - cuts[active, None] / singular, 0.0) / (1.0 + ridge)
        low = (hankel @ (vectors * kept[:, None, :])) @ vectors.transpose(0, 2, 1)
        smooth = np.zeros_like(current)
        for j in range(lag):
            smooth[:, j : j + low.shape[1]] += low[:, :, j]
        moved = np.where(gaps, smooth * weight - current, 0.0)
        current = current + moved
        used[active] += 1
        moving = np.abs(moved).max(axis=1) > tolerance
        if not moving.all():
            z[active[~moving], : current.shape[1]] = current[~moving]
            active = active[moving]
            if not len(active):
                break
            # What is left is often few and short.
            longest = int(spans[active].max())
            current, gaps, weight = (x[moving, :longest] for x in (current, gaps, weight))
            inside = inside[moving, : longest - lag + 1]
    else:
        z[active, : current.shape[1]] = current
    settled = np.ones(len(z), dtype=bool)
    settled[active] = False
    return z, used, settled
