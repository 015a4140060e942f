"""The detector, sessions and daily contacts on streams."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftloom.functions.betting import LOG_FLOOR
from driftloom.functions.theta import theta_value
from driftloom.operators.detector import RIDGE, DetectorConfig
from driftloom.sources.tables import DAY0

ONLINE = (
    "series_id string, t int, logm_trad double, logm_hrzn double, logm_pf array<double>, logm_pf_h array<double>, fired boolean, fired_by string"
)


class OnlineDetector:
    """One series, step by step; the same results as the batch detector.

    What is kept doesn't grow with the series, but for the scores that later
    ones are ranked among: sums and products of the vectors, the last
    ``history_size`` of them, the sorted scores, the wealth. Until the start-up
    is over its vectors are kept too, as normalising needs them.
    """

    #: The state by name; all are arrays.
    KEPT = ("seen", "early", "origin", "total", "first", "second", "window", "scores", "joint_scores", "wealth", "mixed", "joint_wealth", "last", "scale")

    def __init__(self, name: str, config: DetectorConfig, k: int) -> None:
        self.name, self.cfg, self.k = name, config, k
        self.seen = np.zeros(1, dtype=np.int64)
        self.early = np.zeros((0, k))
        # Moments are about the first vector, which loses less to cancellation than about 0.
        self.origin, self.total, self.first, self.second = np.zeros(k), np.zeros(k), np.zeros(k), np.zeros((k, k))
        self.window = np.zeros((0, k))
        # By feature, sorted; undefined scores aren't among them.
        self.scores = np.zeros((k, 0))
        self.joint_scores = np.zeros(0)
        self.wealth = np.zeros((2, k))
        self.mixed = np.zeros((config.horizon if config.horizon_weights else 1, k))
        self.joint_wealth = np.zeros(2)
        self.last = np.array([-config.cooldown - 1])
        self.scale = np.stack([np.zeros(k), np.ones(k)])
        self.rng = np.random.default_rng(config.rng_seed)

    def save(self) -> bytes:
        """The state as bytes."""
        out = io.BytesIO()
        bits = self.rng.bit_generator.state["state"]
        np.savez(out, **{name: getattr(self, name) for name in self.KEPT}, rng=np.array([str(bits["state"]), str(bits["inc"])]))
        return out.getvalue()

    @classmethod
    def load(cls, name: str, config: DetectorConfig, data: bytes) -> OnlineDetector:
        """The detector whose state was saved."""
        z = np.load(io.BytesIO(data))
        self = cls(name, config, len(z["total"]))
        for kept in cls.KEPT:
            setattr(self, kept, z[kept].copy())
        state = self.rng.bit_generator.state
        state["state"] = {"state": int(z["rng"][0]), "inc": int(z["rng"][1])}
        self.rng.bit_generator.state = state
        return self

    def step(self, x: np.ndarray) -> tuple:
        """(sum of observed, sum of forecast, per feature of both, fired, by which stream)."""
        c, t = self.cfg, int(self.seen[0])
        if t < c.startup_period:
            self.early = np.vstack([self.early, x[None]])
            self.seen += 1
            return None, None, self.wealth[0].tolist(), self.wealth[1].tolist(), False, None
        if t == c.startup_period:
            self._begin()
        x = (x - self.scale[0]) / self.scale[1]
        joint = c.detection_mode == "joint"
        score = np.abs(x - self.total / t) if t else np.full(self.k, np.nan)
        if joint:
            jscore = self._distance(x, t)
        draw = [self.rng.uniform() if c.rng == "pcg64" else theta_value(c.rng_seed, self.name, t, j) for j in range(self.k + joint)]
        bet = lambda p: np.log(np.maximum(c.betting.array(np.asarray(p)), 1e-300))
        n = t - c.startup_period
        total: list[float | None] = [None, None]
        if c.enable_traditional:
            above, equal = self._ranks(score)
            p = (above + np.array(draw[: self.k]) * (1.0 + equal)) / (n + 1.0) if n else np.ones(self.k)
            self.wealth[0] = np.maximum(self.wealth[0] + bet(p), LOG_FLOOR)
            if joint:
                above, equal = _rank(self.joint_scores, jscore)
                self.joint_wealth[0] = max(self.joint_wealth[0] + float(bet((above + draw[-1] * (1.0 + equal)) / (n + 1.0) if n else 1.0)), LOG_FLOOR)
            total[0] = float(self.joint_wealth[0]) if joint else _lse(self.wealth[0])
        self._add(x, t)
        if c.enable_horizon and t >= c.history_size:
            center = self.total / (t + 1)
            mixing = c.horizon_weights is not None
            for i, h in enumerate(range(1, c.horizon + 1) if mixing else [c.horizon]):
                forecast = c.forecaster.predict_multi(self.window, h)
                above, equal = self._ranks(np.abs(forecast - center))
                self.mixed[i] = np.maximum(self.mixed[i] + bet((above + equal + 1.0) / (n + 1.0)), LOG_FLOOR)
            with np.errstate(divide="ignore"):
                weights = np.log(np.array(c.horizon_weights if mixing else [1.0]))[:, None]
            self.wealth[1] = [_lse(col) for col in (self.mixed + weights).T]
            if joint:
                above, equal = _rank(self.joint_scores, self._distance(forecast, t + 1))
                self.joint_wealth[1] = max(self.joint_wealth[1] + float(bet((above + equal + 1.0) / (n + 1.0))), LOG_FLOOR)
            total[1] = float(self.joint_wealth[1]) if joint else _lse(self.wealth[1])
        level, ready = np.log(c.threshold), t - self.last[0] > c.cooldown
        by = next((s for s, v in zip(("traditional", "horizon"), total) if ready and v is not None and v >= level), None)
        out = total[0], total[1], self.wealth[0].tolist(), self.wealth[1].tolist(), by is not None, by
        if by:
            self.last[0] = t
            self.wealth[:], self.mixed[:], self.joint_wealth[:] = 0.0, 0.0, 0.0
        self.wealth = np.maximum(self.wealth, LOG_FLOOR)
        if not np.isnan(score).any():
            self.scores = np.stack([np.insert(s, np.searchsorted(s, v), v) for s, v in zip(self.scores, score)])
        if joint:
            self.joint_scores = np.insert(self.joint_scores, np.searchsorted(self.joint_scores, jscore), jscore)
        self.seen += 1
        return out

    def _begin(self) -> None:
        """Take over what the start-up has shown."""
        if self.cfg.normalize_features and self.cfg.startup_period >= 5:
            sd = self.early.std(axis=0, ddof=1)
            self.scale = np.stack([self.early.mean(axis=0), np.where(sd < 1e-10, 1.0, sd)])
        for t, x in enumerate(self.early):
            self._add((x - self.scale[0]) / self.scale[1], t)
        self.early = self.early[:0]

    def _add(self, x: np.ndarray, t: int) -> None:
        if t == 0:
            self.origin = x.copy()
        self.total = self.total + x
        y = x - self.origin
        self.first, self.second = self.first + y, self.second + y[:, None] * y[None, :]
        self.window = np.vstack([self.window, x[None]])[-self.cfg.history_size :]

    def _ranks(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = [_rank(s, v) for s, v in zip(self.scores, points)]
        return np.array([a for a, _ in both], dtype=np.float64), np.array([e for _, e in both], dtype=np.float64)

    def _distance(self, point: np.ndarray, n: int) -> float:
        """The distance of a point from the ``n`` vectors added so far; 0 if there are none."""
        if n == 0:
            return 0.0
        center = self.total / n
        diff = point - center
        euclid = float(np.sqrt((diff**2).sum()))
        metric = self.cfg.joint_distance
        if metric == "chebyshev":
            return float(np.abs(diff).max())
        if metric == "cosine":
            scale = np.sqrt((point**2).sum()) * np.sqrt((center**2).sum())
            return float(1.0 - (point * center).sum() / scale) if scale > 0 else euclid
        if metric == "mahalanobis" and n >= 2:
            cov = (self.second - self.first[:, None] * self.first[None, :] / n) / (n - 1) + RIDGE * np.eye(self.k)
            return float(np.sqrt(max(diff @ np.linalg.solve(cov, diff), 0.0)))
        return euclid


def _rank(scores: np.ndarray, point: float) -> tuple[int, int]:
    """How many of the sorted scores are above and equal to a point; NaN compares with nothing."""
    if np.isnan(point):
        return 0, 0
    low, high = np.searchsorted(scores, point, side="left"), np.searchsorted(scores, point, side="right")
    return len(scores) - high, high - low


def _lse(v: np.ndarray) -> float:
    top = v.max()
    return float(top + np.log(np.exp(v - top).sum())) if np.isfinite(top) else float(top)


def detect_stream(features: DataFrame, config: DetectorConfig) -> DataFrame:
    """The detector's trace of a stream ``series_id STRING, t INT, x ARRAY<DOUBLE>``, in append mode.

    A series' steps must arrive in order of t from one micro-batch to the next
    (within one they may come in any order). A step at or before one already
    seen is a repeat or too late; it is left out. State per series: see
    :class:`OnlineDetector`.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("t").drop_duplicates("t")
        saved, seen = state.get if state.exists else (None, -(2**31))
        rows = rows[rows["t"] > seen]
        if not len(rows):
            return
        first = np.asarray(rows["x"].iloc[0], dtype=np.float64)
        detector = OnlineDetector.load(key[0], config, saved) if saved else OnlineDetector(key[0], config, len(first))
        out = [(key[0], int(t), *detector.step(np.asarray(x, dtype=np.float64))) for t, x in zip(rows["t"], rows["x"])]
        state.update((detector.save(), int(rows["t"].iloc[-1])))
        yield pd.DataFrame(out, columns=["series_id", "t", "logm_trad", "logm_hrzn", "logm_pf", "logm_pf_h", "fired", "fired_by"])

    grouped = features.select("series_id", "t", "x").groupBy("series_id")
    return grouped.applyInPandasWithState(advance, ONLINE, "state binary, seen int", "append", GroupStateTimeout.NoTimeout)


def sessions_stream(events: DataFrame, entity: str, time: str, gap_seconds: int, lateness: str) -> DataFrame:
    """``entity, start, end, n_events`` of sessions on a stream; a session is emitted once the watermark has passed its gap.

    ``time`` must be a timestamp. ``end`` is the last event's time plus the gap.
    """
    rows = events.select(F.col(entity).alias("entity"), F.col(time).alias("time")).withWatermark("time", lateness)
    found = rows.groupBy("entity", F.session_window("time", f"{gap_seconds} seconds").alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    return found.select("entity", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_events")


def daily_contacts_stream(log: DataFrame, time: str, a: str, b: str, lateness: str, day0: str = DAY0) -> DataFrame:
    """``day, u, v, readings``: the contact pairs of each day on a stream, emitted when the watermark has closed the day.

    Readings later than ``lateness`` are left out, as are loops and unknown ends.
    """
    rows = log.select(F.col(time).alias("time"), F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
    rows = rows.filter("a is not null and b is not null and a <> b").withWatermark("time", lateness)
    found = rows.groupBy(F.window("time", "1 day").alias("w"), "u", "v").agg(F.count(F.lit(1)).alias("readings"))
    return found.select(F.datediff(F.col("w.start"), F.lit(day0).cast("date")).alias("day"), "u", "v", "readings")


def with_end(log: DataFrame, time: str, a: str, b: str, folder: str) -> DataFrame:
    """A finite log on a stream, followed by a contact far in the future between ``LAST_PAIR``, so that the watermark closes every window before it."""
    spark = log.sparkSession
    end = spark.range(1).select(F.lit("9000-01-01").cast("timestamp").alias(time), F.lit(LAST_PAIR[0]).alias(a.strip("`")), F.lit(LAST_PAIR[1]).alias(b.strip("`")))
    end.write.parquet(f"{folder}/end")
    return log.select(time, a, b).unionByName(spark.readStream.schema(end.schema).parquet(f"{folder}/end"))


#: Ids that no user has.
LAST_PAIR = (-2, -1)


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Everything a stream has now, run in micro-batches into Parquet files below ``folder``, read back."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
