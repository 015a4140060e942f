"""Features, scores, bets, detectors, charts, metrics and generators against closed forms, golden values and plain loops."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.functions import betting
from driftloom.functions.attribution import driver, shares, wealth
from driftloom.functions.sql import register
from driftloom.functions.theta import theta, theta_value
from driftloom.operators import detector, graphs, metrics, windows
from driftloom.operators.charts import Cusum, EwmaChart, control_chart
from driftloom.operators.detector import DetectorConfig, Ewma, Holt, detect, detect_many, detections, distances, ranks, trace
from driftloom.operators.graph_forecast import GraphForecast, diagnostics, forecast_edges, forecast_features
from driftloom.operators.order import dense_index
from driftloom.operators.series import clean_features
from driftloom.plans.api import Detector
from driftloom.sources.generators import SCENARIOS, change_points, erdos_renyi, generate, preferential_attachment, small_world, two_blocks
from driftloom.sources.proximity import contact_graphs, labelled_days, read_csv
from driftloom.streaming.online import OnlineDetector, daily_contacts_stream, detect_stream, run_to_end, sessions_stream

# Graph features

GRAPHS = {
    "K5": (5, [(a, b) for a in range(5) for b in range(a)], (4, 1, 0, 1, 0.4472136, 5, 0, 1)),
    "path4": (4, [(0, 1), (1, 2), (2, 3)], (1.5, 0, 1 / 3, 0.625, 0.48662449, 0.58578644, 1.4142136, 0.5)),
    "path10": (10, [(i, i + 1) for i in range(9)], (1.8, 0, 1 / 3, 0.28537983, 0.29656871, 0.09788697, 0.28407904, 0.2)),
    "cycle7": (7, [(i, (i + 1) % 7) for i in range(7)], (2, 0, 0.2, 0.5, 0.37796447, 0.7530204, 0, 1 / 3)),
    "star": (5, [(0, i) for i in range(1, 5)], (1.6, 0, 0.2, 0.65714286, 0.42426407, 1, 0, 0.4)),
    "triangle+1": (4, [(0, 1), (1, 2), (0, 2)], (1.5, 0.75, 0, 0.5, 0.4330127, 0, 3, 0.5)),
    "mixed": (5, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4)], (2, 0.46666667, 0.23333333, 0.61079365, 0.41903291, 0.5188057, 1.7923021, 0.5)),
    "empty10": (10, [], (0,) * 8),
    "none": (0, [], (0,) * 8),
    "one": (1, [], (0,) * 8),
    "two": (2, [(1, 0)], (1, 0, 0, 1, 0.70710678, 2, 0, 1)),
}


def frames(spark, items):
    snapshots = spark.createDataFrame([(s, t, n) for s, t, n, _ in items], "series_id string, t int, n int")
    edges = spark.createDataFrame([(s, t, int(u), int(v)) for s, t, _, e in items for u, v in e], "series_id string, t int, u int, v int")
    return snapshots, edges


def test_features_of_known_graphs(spark):
    # Either orientation, repeats, loops and nulls in the edges change nothing.
    snapshots, edges = frames(spark, [(name, 0, n, [*e, *[(v, u) for u, v in e[:2]], *[(0, 0)] * (n > 0)]) for name, (n, e, _) in GRAPHS.items()])
    edges = edges.union(spark.createDataFrame([("K5", 0, None, 1), (None, 0, 0, 1)], edges.schema))
    got = {r.series_id: r.x for r in graphs.extract(snapshots, edges).collect()}
    for name, (_, _, want) in GRAPHS.items():
        assert got[name] == pytest.approx(want, abs=1e-7), name
    counted = {r.series_id: r for r in graphs.counts(snapshots, edges).collect()}
    closed = {r.series_id: r for r in graphs.clustering(snapshots, edges).collect()}
    for name, (_, _, want) in GRAPHS.items():
        assert (counted[name].mean_degree, counted[name].density, closed[name].mean_clustering) == pytest.approx((want[0], want[7], want[1]))
    assert closed["K5"].triangles == 10
    assert graphs.names() == ["mean_degree", "mean_clustering", "mean_betweenness", "mean_closeness", "mean_eigenvector", "algebraic_connectivity", "spectral_gap", "density"]


def brandes(n: int, edges: list) -> float:
    """Mean normalised betweenness by counting shortest paths."""
    near = [[] for _ in range(n)]
    for u, v in edges:
        near[u].append(v)
        near[v].append(u)
    total = 0.0
    for s in range(n):
        order, paths, dist = [s], [0] * n, [-1] * n
        paths[s], dist[s] = 1, 0
        for v in order:
            for w in near[v]:
                if dist[w] < 0:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        part = [0.0] * n
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    part[v] += paths[v] / paths[w] * (1 + part[w])
            if w != s:
                total += part[w]
    return total / n / ((n - 1) * (n - 2))


def test_features_are_invariant_and_match_path_counting(spark):
    rng = np.random.default_rng(0)
    items = []
    for k, sampler in enumerate([erdos_renyi(0.2), two_blocks(0.9, 0.05), erdos_renyi(0.05), preferential_attachment(2), small_world(4, 0.2)]):
        e = sampler(rng, 30)
        p = rng.permutation(30)
        items += [(f"{k}", 0, 30, e), (f"{k}", 1, 30, p[e] if len(e) else e)]
    got = {(r.series_id, r.t): r.x for r in graphs.extract(*frames(spark, items)).collect()}
    closed = {(r.series_id, r.t): r.mean_clustering for r in graphs.clustering(*frames(spark, items)).collect()}
    for s, t, n, e in items:
        assert got[(s, t)] == pytest.approx(got[(s, 0)], abs=1e-8)
        assert got[(s, t)][2] == pytest.approx(brandes(n, [tuple(x) for x in e]), abs=1e-12)
        assert got[(s, t)][1] == pytest.approx(closed[(s, t)], abs=1e-12)


@pytest.mark.parametrize("memory", [(4_000_000, 64_000_000), (1, 1), (7, 100)])
def test_large_graphs_have_the_same_features(monkeypatch, memory):
    """By neighbour lists as by matrices, however little is held at once."""
    rng = np.random.default_rng(3)
    batches = []
    for n, p in ((0, 0), (1, 0), (2, 1.0), (5, 0.0), (12, 0.3), (40, 0.1), (40, 0.02), (25, 1.0), (60, 0.05)):
        u, v = np.triu_indices(n, 1)
        keep = rng.random(len(u)) < p
        batches.append((n, u[keep].tolist(), v[keep].tolist()))
    ids = pa.array([str(i) for i in range(len(batches))])
    batch = pa.RecordBatch.from_arrays(
        [ids, pa.array(range(len(batches)), pa.int32()), pa.array([n for n, _, _ in batches], pa.int32()), pa.array([u for _, u, _ in batches], pa.list_(pa.int32())), pa.array([v for _, _, v in batches], pa.list_(pa.int32()))],
        names=["series_id", "t", "n", "u", "v"],
    )
    whole = graphs._extract_batch(batch, graphs.DEFAULT).column(2).to_pylist()
    monkeypatch.setattr(graphs, "DENSE_NODES", -1)
    monkeypatch.setattr(graphs, "PAIRS", memory[0])
    monkeypatch.setattr(graphs, "PATH_BYTES", memory[1])
    for row, other in zip(graphs._extract_batch(batch, graphs.DEFAULT).column(2).to_pylist(), whole):
        assert row == pytest.approx(other, abs=1e-12)


def test_custom_feature(spark):
    snapshots, edges = frames(spark, [("a", 0, 5, GRAPHS["K5"][1])])
    own = graphs.Feature("edges", lambda a, shared: a.sum(axis=(1, 2)) / 2)
    assert graphs.extract(snapshots, edges, (own, graphs.Feature("tri", graphs.triangle_count))).first().x == [10.0, 6.0]


# Bets


def test_bets(spark):
    p = [1.0, 0.5, 0.1, 0.01, 0.0, None]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    for bet, want in (
        (betting.default(), [0.8, 0.91511863, 1.26587702, 2.07422107, 263.0, None]),
        (betting.power(0.5), [0.5, 0.5**0.5, 0.5 * 0.1**-0.5, 5.0, 0.5e5, None]),
        (betting.beta(2, 5), [None] * 6),
    ):
        got = [r[0] for r in df.select(bet(F.col("p"))).collect()]
        array = bet.array(np.array([x for x in p if x is not None]))
        assert got[:5] == pytest.approx(list(array), rel=1e-9) and got[5] is None
        if want[0] is not None:
            assert got[:5] == pytest.approx(want[:5], rel=1e-2 if bet.name == "mixture" else 1e-7)
    assert betting.beta(2, 5).array(np.array([0.25]))[0] == pytest.approx(2.37304688)
    assert betting.power(0.5).array(np.array([0.25]))[0] == 1.0


@pytest.mark.parametrize("bet", [betting.power(0.2), betting.power(0.5), betting.power(0.9), betting.default(), betting.mixture((0.5, 0.5), (0.3, 0.6)), betting.beta(2, 5), betting.beta(1, 1), betting.beta(0.7, 3)])
def test_bets_are_fair(bet):
    floor = max([e * betting.P_FLOOR**e for e in bet.params] if bet.name == "power" else [0.0])
    assert betting.calibration(bet) == pytest.approx(1.0, abs=8 * floor + 2e-3)


def test_bets_refuse_bad_parameters():
    for make in (lambda: betting.power(0), lambda: betting.power(1), lambda: betting.mixture((1,), (0.5, 0.6)), lambda: betting.mixture((-1, 2), (0.5, 0.6)),
                 lambda: betting.mixture((0.5, 0.6), (0.5, 0.6)), lambda: betting.mixture((1,), (1.5,)), lambda: betting.beta(0, 1)):
        with pytest.raises(ValueError):
            make()
    lame = betting.custom("half", lambda p: F.lit(0.5), lambda p: np.full(np.shape(p), 0.5))
    assert betting.calibration(lame) == pytest.approx(0.5)


def test_log_sum_exp_and_shares(spark):
    rows = [[0.1, 0.2, 0.5, 1.0], [2.3] * 4, [10.0, 0.0, 0.0, 0.0], [-math.inf] * 4, [700.0, 500.0, 300.0, 100.0], [-1.0, 5.0, 2.0, 4.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, m array<double>")
    m = F.col("m")
    got = df.select("i", betting.log_sum_exp(m).alias("s"), shares(m).alias("u"), shares(m, "zero").alias("z"), driver(m).alias("d"), wealth(m[0]).alias("w")).orderBy("i").collect()
    for r, row in zip(got, rows):
        assert sum(r.u) == pytest.approx(100.0)
        assert r.d == int(np.argmax(row))
        if math.isinf(row[0]):
            assert r.s == -math.inf and r.u == [25.0] * 4 and r.z == [0.0] * 4
        else:
            assert r.s == pytest.approx(max(row) + math.log(sum(math.exp(x - max(row)) for x in row)))
    assert got[1].u == [25.0] * 4 and got[4].u[0] == pytest.approx(100.0)
    with pytest.raises(ValueError):
        shares(m, "other")


def test_theta(spark):
    df = spark.createDataFrame([("a|b", 3, 1), ("x", 720, 0)], "s string, t int, k int")
    got = [r[0] for r in df.select(theta(7, F.col("s"), F.col("t"), F.col("k"))).collect()]
    assert got == [theta_value(7, "a|b", 3, 1), theta_value(7, "x", 720, 0)]
    many = [theta_value(0, "s", t, 0) for t in range(4000)]
    assert abs(np.mean(many) - 0.5) < 0.02 and 0 < min(many) and max(many) < 1


# Windows


def long(spark, x, series="a"):
    return spark.createDataFrame([(series, t, k, float(v)) for t, row in enumerate(x) for k, v in enumerate(row)], "series_id string, t int, k int, x double")


def test_window_expressions(spark):
    x = [[4.0], [5], [4], [6], [5], [4], [5], [6], [5], [4]]
    df = windows.running_moments(windows.nonconformity(windows.centroids(long(spark, x))))
    df = windows.predictive_pvalues(windows.ewma_forecast(df, 0.5, 3).withColumn("s_ahead", F.abs(F.col("forecast") - F.col("c_now"))))
    rows = windows.conformal_pvalues(df).orderBy("t").collect()
    past = np.array(x)[:, 0]
    assert rows[0].c is None and rows[0].s == 0.0 and rows[0].p is None and rows[0].p_ahead == 1.0 and rows[1].sd is None
    pool: list[float] = []
    for t, r in enumerate(rows):
        if t:
            assert (r.c, r.mean) == pytest.approx((past[:t].mean(),) * 2)
            above, equal = sum(v > r.s for v in pool), sum(v == r.s for v in pool)
            assert r.p == pytest.approx((above + theta_value(0, "a", t, 0) * (1 + equal)) / (t + 1))
        if t > 1:
            assert r.sd == pytest.approx(past[:t].std(ddof=1))
        w = past[max(0, t - 2) : t + 1]
        weights = 0.5 ** np.arange(len(w))[::-1]
        assert r.forecast == pytest.approx((w * weights).sum() / weights.sum())
        assert r.p_ahead == pytest.approx((sum(v >= r.s_ahead for v in pool) + 1) / (len(pool) + 1))
        pool.append(r.s)


def test_scores_of_both_forms_agree(spark):
    stacks = {"a": shifted(0, 40), "b": shifted(1, 25)}
    got = {(r.series_id, r.t): r for r in detector.scores(feature_frame(spark, stacks)).collect()}
    for name, x in stacks.items():
        for r in windows.conformal_pvalues(windows.nonconformity(windows.centroids(long(spark, x, name)))).collect():
            mine = got[name, r.t]
            assert mine.s[r.k] == pytest.approx(r.s, abs=1e-12)
            assert (mine.c[r.k], mine.p[r.k]) == ((None, None) if r.t == 0 else (pytest.approx(r.c), pytest.approx(r.p)))


def test_forecasts(spark):
    assert Ewma(0.5).predict_multi(np.array([[1.0], [2], [3]]), 1)[0] == pytest.approx(17 / 7)
    assert Holt().predict_multi(np.array([[1.0], [2], [4]]), 2)[0] == pytest.approx(5.36)
    got = windows.holt_forecast(long(spark, [[1.0], [2], [4]]), 2).orderBy("t").collect()
    assert got[0].forecast == 1.0 and got[2].forecast == pytest.approx(5.36)
    for bad in (lambda: Ewma(1.0), lambda: Holt(0.0), lambda: windows.ewma_forecast(long(spark, [[1.0]]), 0.0)):
        with pytest.raises(ValueError):
            bad()


def test_log_martingale_is_the_clamped_fold(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0.5, 1, 400)
    p[200:] = rng.beta(0.2, 1, 200)
    bet = betting.custom("steep", lambda c: F.when(c > 0.5, F.lit(1e-12)).otherwise(betting.power(0.5)(c)), lambda q: np.where(q > 0.5, 1e-12, betting.power(0.5).array(q)))
    df = spark.createDataFrame([("a", t, 0, None if t == 300 else float(v)) for t, v in enumerate(p)], "series_id string, t int, k int, p double")
    got = [r.logm for r in windows.log_martingale(df, bet).orderBy("t").collect()]
    want, level = [], 0.0
    for t, v in enumerate(p):
        if t not in (0, 300):
            level = max(level + math.log(bet.array(np.array([v]))[0]), betting.LOG_FLOOR)
        want.append(level)
    assert got == pytest.approx(want, abs=1e-7) and min(want) == betting.LOG_FLOOR
    total = windows.sum_martingale(windows.log_martingale(df, bet)).orderBy("t").collect()
    assert [r.total for r in total] == pytest.approx(want, abs=1e-7)


def test_normalise(spark):
    x = np.random.default_rng(0).normal(3, 2, (30, 1)).tolist()
    got = [r.x for r in windows.normalise(long(spark, [[*v, 7.0] for v in x]), 10).orderBy("k", "t").collect()]
    first = np.array(x)[:10, 0]
    assert got[:30] == pytest.approx(list((np.array(x)[:, 0] - first.mean()) / first.std(ddof=1))) and got[30:] == pytest.approx([0.0] * 30)
    assert [r.x for r in windows.normalise(long(spark, x), 4).orderBy("t").collect()] == [v[0] for v in x]


def test_clean_features(spark):
    day = datetime(2009, 1, 1)
    rows = [
        ("a", 0, [1.0, None], day), ("a", 1, None, day), ("a", 2, [3.0, 4.0], day), ("a", 2, [5.0, 6.0], day + timedelta(1)), ("a", 2, None, day + timedelta(2)),
        ("a", 3, [float("nan"), 8.0], day), (None, 1, [1.0, 1.0], day), ("a", None, [1.0, 1.0], day), ("b", 0, None, day), ("a", 3, [float("nan"), 8.0], day),
    ]
    df = spark.createDataFrame(rows, "series_id string, t int, x array<double>, at timestamp_ntz")
    got = {(r.series_id, r.t): r.x for r in clean_features(df, "at").collect()}
    assert got == {("a", 0): [1.0, 0.0], ("a", 1): [1.0, 0.0], ("a", 2): [5.0, 6.0], ("a", 3): [5.0, 8.0]}


# Detectors

X = np.array([4, 5, 4, 6, 5, 4, 5, 6, 5, 4, 12, 13, 12, 14, 13, 12], dtype=float)[None, :, None]
SECOND = np.array([1, 2, 1, 3, 2, 1, 2, 3, 1, 2, 1, 2, 3, 1, 2, 1], dtype=float)[None, :, None]
GOLDEN = [
    (4, 1, 1, -0.22314355, -0.22314355), (5, 0.25, 1, -0.17421484, -0.4462871), (6, 0.5, 1, -0.26291641, -0.66943065), (7, 0.125, 0.5, -0.07316436, -0.75813223),
    (8, 0.9, 0.6, -0.27607718, -0.88250514), (9, 0.25, 5 / 6, -0.22714847, -1.070594), (10, 1 / 14, 1 / 7, 0.07862099, -0.9082189), (11, 0.0625, 0.25, 0.412379, -0.8592902),
    (12, 5 / 18, 1 / 3, 0.44018163, -0.8678709), (13, 0.15, 0.3, 0.59258313, -0.85545325), (14, 7 / 22, 5 / 11, 0.59326477, -0.9254195), (15, 11 / 24, 0.5, 0.52166481, -1.01412107),
]


def test_golden_trace(monkeypatch):
    monkeypatch.setattr(detector, "_thetas", lambda series, cfg, steps, k, made: np.full((len(series), steps, k), 0.5))
    base = {"startup_period": 4, "history_size": 3, "cooldown": 0}
    out = trace(["a"], X, DetectorConfig(threshold=1e300, **base))
    for t, p, ph, lt, lh in GOLDEN:
        assert (out["p"][0, t, 0], out["p_h"][0, t, 0], out["logm_trad"][0, t], out["logm_hrzn"][0, t]) == pytest.approx((p, ph, lt, lh), abs=1e-7)
    out = trace(["a"], X, DetectorConfig(threshold=1.5, **base))
    assert np.flatnonzero(out["fired"][0]).tolist() == [11] and out["fired_by"][0, 11] == "traditional"
    assert out["logm_trad"][0, 12:].tolist() == pytest.approx([0.02780263, 0.18020414, 0.18088578, 0.10928581], abs=1e-7)
    assert out["logm_hrzn"][0, 12:].tolist() == pytest.approx([-0.0085807, 0.00383695, -0.0661293, -0.15483087], abs=1e-7)
    out = trace(["a"], np.concatenate([X, SECOND], axis=2), DetectorConfig(threshold=2.5, **base))
    assert np.flatnonzero(out["fired"][0]).tolist() == [13]
    assert (out["logm_trad"][0, 4], out["logm_trad"][0, 13], out["logm_trad"][0, 14], out["logm_hrzn"][0, 14]) == pytest.approx((0.47000363, 0.91776816, 0.59213973, 0.54952233), abs=1e-7)


def distance_reference(rows: np.ndarray, metric: str) -> float:
    past, now = rows[:-1], rows[-1]
    if not len(past):
        return 0.0
    diff = now - past.mean(axis=0)
    if metric == "chebyshev":
        return np.abs(diff).max()
    if metric == "cosine" and np.linalg.norm(now) * np.linalg.norm(past.mean(axis=0)) > 0:
        return 1 - now @ past.mean(axis=0) / np.linalg.norm(now) / np.linalg.norm(past.mean(axis=0))
    if metric == "mahalanobis" and len(past) > 1:
        return math.sqrt(diff @ np.linalg.solve(np.atleast_2d(np.cov(past, rowvar=False)) + 1e-6 * np.eye(len(diff)), diff))
    return float(np.linalg.norm(diff))


def loop_reference(x: np.ndarray, c: DetectorConfig) -> dict:
    """The detector step by step, written down from its description."""
    steps, k = x.shape
    rng = np.random.default_rng(c.rng_seed)
    if c.normalize_features and c.startup_period >= 5:
        sd = x[: c.startup_period].std(axis=0, ddof=1)
        x = (x - x[: c.startup_period].mean(axis=0)) / np.where(sd < 1e-10, 1, sd)
    bet = lambda p: float(np.log(max(c.betting.array(np.array([p]))[0], 1e-300)))
    add = lambda a, b: max(betting.LOG_FLOOR, a + b)
    lse = lambda v: max(v) + math.log(sum(math.exp(y - max(v)) for y in v))
    joint, mixed = c.detection_mode == "joint", c.horizon_weights
    hs = range(1, c.horizon + 1) if mixed else [c.horizon]
    a, h, per = [0.0] * k, [0.0] * k, [[0.0] * k for _ in hs]
    ja = jh = 0.0
    pool, jpool, last = [[] for _ in range(k)], [], -c.cooldown - 1
    out = {"a": [], "h": [], "fired": []}
    for t in range(steps):
        sa = sh = None
        if t >= c.startup_period:
            score = np.abs(x[t] - x[:t].mean(axis=0))
            for j in range(k):
                u = rng.uniform()
                n = len(pool[j])
                p = (sum(v > score[j] for v in pool[j]) + u * (1 + sum(v == score[j] for v in pool[j]))) / (n + 1) if n else 1.0
                if c.enable_traditional:
                    a[j] = add(a[j], bet(p))
            if joint:
                s, u, n = distance_reference(x[: t + 1], c.joint_distance), rng.uniform(), len(jpool)
                if c.enable_traditional:
                    ja = add(ja, bet((sum(v > s for v in jpool) + u * (1 + sum(v == s for v in jpool))) / (n + 1) if n else 1.0))
            if c.enable_traditional:
                sa = ja if joint else lse(a)
            if c.enable_horizon and t >= c.history_size:
                for i, hh in enumerate(hs):
                    f = c.forecaster.predict_multi(x[t - c.history_size + 1 : t + 1], hh)
                    ahead = np.abs(f - x[: t + 1].mean(axis=0))
                    for j in range(k):
                        per[i][j] = add(per[i][j], bet((sum(v >= ahead[j] for v in pool[j]) + 1) / (len(pool[j]) + 1)))
                h = [lse([per[i][j] + math.log(w) for i, w in enumerate(mixed) if w > 0]) for j in range(k)] if mixed else list(per[0])
                if joint:
                    sj = distance_reference(np.vstack([x[: t + 1], f]), c.joint_distance)
                    jh = add(jh, bet((sum(v >= sj for v in jpool) + 1) / (len(jpool) + 1)))
                sh = jh if joint else lse(h)
            for j in range(k):
                pool[j].append(score[j])
            if joint:
                jpool.append(s)
        level = math.log(c.threshold)
        fired = t - last > c.cooldown and ((sa is not None and sa >= level) or (sh is not None and sh >= level))
        if fired:
            last, a, h, per, ja, jh = t, [0.0] * k, [0.0] * k, [[0.0] * k for _ in hs], 0.0, 0.0
        out["a"].append(sa)
        out["h"].append(sh)
        out["fired"].append(fired)
    return out


MODES = {
    "plain": {}, "holt": {"forecaster": Holt()}, "normal": {"normalize_features": True}, "mixture": {"horizon": 3, "horizon_weights": (0.5, 0.0, 0.5), "forecaster": Holt()},
    "observed": {"enable_horizon": False}, "ahead": {"enable_traditional": False}, "bet": {"betting": betting.beta(0.5, 0.5)}, "cool": {"cooldown": 9}, "no startup": {"startup_period": 1},
    "euclidean": {"detection_mode": "joint", "joint_distance": "euclidean"}, "mahalanobis": {"detection_mode": "joint"}, "cosine": {"detection_mode": "joint", "joint_distance": "cosine"},
    "chebyshev": {"detection_mode": "joint", "joint_distance": "chebyshev"}, "joint mixture": {"detection_mode": "joint", "horizon": 2, "horizon_weights": (0.3, 0.7), "forecaster": Holt()},
}


def shifted(seed: int, steps: int = 90, k: int = 3) -> np.ndarray:
    x = np.random.default_rng(seed).normal(size=(steps, k)).round(2)
    x[steps // 2 :] += 3
    return x


def feature_frame(spark, stacks: dict):
    return spark.createDataFrame([(s, t, row.tolist()) for s, x in stacks.items() for t, row in enumerate(x)], "series_id string, t int, x array<double>")


def test_every_mode_against_the_loop(spark):
    base = {"threshold": 6.0, "startup_period": 10, "history_size": 6, "cooldown": 3, "rng": "pcg64", "rng_seed": 5}
    configs = {name: DetectorConfig(**(base | extra)) for name, extra in MODES.items()}
    stacks = {"s0": shifted(0), "s1": shifted(1), "short": shifted(2, 8), "other": shifted(3, 60, 2)}
    got: dict = {}
    for r in detect_many(feature_frame(spark, stacks).repartition(3), configs).orderBy("t").collect():
        got.setdefault((r.config, r.series_id), []).append((r.logm_trad, r.logm_hrzn, r.fired))
    alarms = 0
    for (name, s), rows in got.items():
        want = loop_reference(stacks[s], configs[name])
        for (a, h, fired), wa, wh, wf in zip(rows, want["a"], want["h"], want["fired"]):
            assert a == (None if wa is None else pytest.approx(wa, abs=1e-6)), (name, s)
            assert h == (None if wh is None else pytest.approx(wh, abs=1e-6)), (name, s)
            assert fired == wf, (name, s)
            alarms += fired
    assert alarms > 20


def test_series_are_independent_and_the_stream_equals_the_batch(spark):
    config = DetectorConfig(threshold=6.0, startup_period=10, history_size=6, cooldown=3)
    stacks = {"s0": shifted(0), "s1": shifted(1)}
    both = {(r.series_id, r.t): r for r in detect(feature_frame(spark, stacks), config).collect()}
    alone = {(r.series_id, r.t): r for r in detect(feature_frame(spark, {"s1": stacks["s1"]}).repartition(1), config).collect()}
    assert all(both[key] == r for key, r in alone.items())
    for extra in ({}, {"rng": "pcg64"}, {"detection_mode": "joint"}, {"normalize_features": True}, {"startup_period": 0},
                  *[{"detection_mode": "joint", "joint_distance": m, "enable_horizon": m != "cosine"} for m in ("euclidean", "cosine", "chebyshev")], {"horizon": 2, "horizon_weights": (0.4, 0.6)}):
        c = DetectorConfig(**({"threshold": 6.0, "startup_period": 10, "history_size": 6, "cooldown": 3} | extra))
        batch = trace(["s0"], stacks["s0"][None], c)
        online = OnlineDetector("s0", c, 3)
        for t, x in enumerate(stacks["s0"]):
            if t == 40:
                online = OnlineDetector.load("s0", c, online.save())
            a, h, pf, pfh, fired, by = online.step(x)
            for got, want in ((a, batch["logm_trad"][0, t]), (h, batch["logm_hrzn"][0, t])):
                assert got is None if np.ma.is_masked(want) else got == pytest.approx(want)
            assert len(online.window) <= c.history_size and online.early.shape[0] <= c.startup_period
            assert fired == batch["fired"][0, t] and pf == pytest.approx(batch["logm_pf"][0, t]) and pfh == pytest.approx(batch["logm_pf_h"][0, t])


def test_dirac_mixture_is_the_single_horizon_and_configs_are_checked(spark):
    stacks = feature_frame(spark, {"s0": shifted(0)})
    single = DetectorConfig(horizon=3, forecaster=Holt(), threshold=20.0)
    mixed = DetectorConfig(horizon=3, forecaster=Holt(), threshold=20.0, horizon_weights=(0.0, 0.0, 1.0))
    rows = detect_many(stacks, {"a": single, "b": mixed}).orderBy("t").collect()
    a, b = ([(r.logm_trad, r.logm_hrzn, r.fired) for r in rows if r.config == c] for c in "ab")
    assert all((x[0] == y[0] and x[2] == y[2] and (x[1] is None or x[1] == pytest.approx(y[1]))) for x, y in zip(a, b))
    for bad in ({"horizon": 0}, {"history_size": 1}, {"startup_period": -1}, {"enable_traditional": False, "enable_horizon": False}, {"detection_mode": "x"}, {"joint_distance": "x"},
                {"horizon_weights": (1.0,)}, {"horizon": 2, "horizon_weights": (-1.0, 2.0)}, {"horizon": 2, "horizon_weights": (0.5, 0.6)}, {"threshold": 0.0}, {"rng": "x"}):
        with pytest.raises(ValueError):
            DetectorConfig(**bad)
    with pytest.raises(TypeError):
        detect(stacks, single, threshold=3.0)


def test_attribution_of_alarms(spark):
    x = shifted(4)
    x[:, 1:] = np.random.default_rng(9).normal(size=(90, 2))
    found = detections(detect(feature_frame(spark, {"s": x}), threshold=20.0, startup_period=10, history_size=6), ["first", "second", "third"]).collect()
    assert found and all(r.driver == "first" and r.driver_pct > 50 for r in found)


def test_custom_forecaster_and_false_alarms(spark):
    class Last:
        def predict_multi(self, window, horizon):
            return window[-1]

    quiet = np.random.default_rng(0).normal(size=(60, 150, 1))
    out = trace([f"s{i}" for i in range(60)], quiet, DetectorConfig(forecaster=Last(), threshold=20.0, rng="pcg64", enable_horizon=False))
    # By Ville's inequality at most 1 in 20 on average.
    assert out["fired"].any(axis=1).mean() <= 0.1
    out = trace(["a"], shifted(0)[None], DetectorConfig(forecaster=Last(), startup_period=10, history_size=6))
    assert not np.ma.is_masked(out["logm_hrzn"][0, -1])


def ranks_reference(pool, points, start):
    above, equal = np.zeros(points.shape), np.zeros(points.shape)
    for t in range(start + 1, pool.shape[1]):
        past, now = pool[:, start:t], points[:, t : t + 1]
        above[:, t], equal[:, t] = (past > now).sum(axis=1), (past == now).sum(axis=1)
    return above, equal


@pytest.mark.parametrize("steps", [0, 1, 64, 65, 200, 1000, 4096, 4097])
@pytest.mark.parametrize("start", [0, 3, 70])
def test_ranks(steps, start):
    """Ties, undefined and infinite scores, on either side of every block's end."""
    rng = np.random.default_rng(steps + start)
    for shape in ((2, steps), (1, steps, 3)):
        pool, points = rng.integers(0, 50, shape).astype(float), rng.integers(0, 50, shape).astype(float)
        for x in (pool, points):
            for odd in (np.nan, np.inf, -np.inf):
                x[rng.random(shape) < 0.03] = odd
        for now in (points, pool):
            got, want = ranks(pool, now, start), ranks_reference(pool, now, start)
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_trace_does_not_depend_on_the_length():
    """With start-up 0 the first score is undefined; it counts as a step and equals nothing, however long the series."""
    x = np.round(np.random.default_rng(5).normal(size=(1, 4097, 2)), 1)
    cfg = DetectorConfig(startup_period=0, history_size=3, enable_horizon=True)
    whole, part = trace(["a"], x, cfg), trace(["a"], x[:, :4096], cfg)
    for key in ("p", "p_h", "logm_trad", "logm_hrzn", "fired"):
        assert np.ma.allequal(whole[key][:, :4096], part[key])
    early = trace(["a"], x[:, :50], cfg)
    assert np.ma.allequal(whole["p"][:, :50], early["p"])


def test_distances():
    x = np.array([[1.0, 2], [2, 1], [3, 5], [4, 3], [9, 1]])[None]
    for metric, want in (("euclidean", 6.73145601), ("chebyshev", 6.5), ("cosine", 0.24972874), ("mahalanobis", 6.65206397)):
        got = distances(x, x, 0, metric)[0]
        assert got[0] == 0.0 and got[-1] == pytest.approx(want, abs=1e-6)
        assert got.tolist() == pytest.approx([distance_reference(x[0, : t + 1], metric) for t in range(5)])
    with pytest.raises(ValueError):
        distances(x, x, 0, "other")


def test_charts(spark):
    x = feature_frame(spark, {"a": X[0]})
    got = control_chart(x, Cusum(startup_period=4)).orderBy("t").collect()
    assert [r.score_max for r in got[4:]] == pytest.approx([0, 0.456183, 0, 1.20084, 0.850626, 0.63707, 8.627666, 2.786001, 4.201806, 5.908252, 1.055152, 1.694264], abs=1e-5)
    assert [r.t for r in got if r.fired] == [10, 13] and got[3].score_max is None
    got = control_chart(x, EwmaChart(startup_period=4)).orderBy("t").collect()
    assert [r.score_max for r in got[4:]] == pytest.approx([0.261116, 0.726217, 0.11665, 1.228455, 0.550034, 0.439512, 6.425276, 1.874803, 2.004668, 2.632997, 2.512435, 2.332578], abs=1e-5)
    assert [(r.t, r.breach_k) for r in got if r.fired] == [(10, 0)]
    flat = feature_frame(spark, {"c": np.tile([1.7, -0.5, 7.2], (60, 1))})
    for chart in (Cusum(), EwmaChart()):
        assert control_chart(flat, chart).filter("fired").count() == 0
    with pytest.raises(ValueError):
        EwmaChart(lambda_=0.0)


# Evaluation


def match_reference(steps, delta, truth, found):
    free, hits = sorted(found), []
    for cp in sorted(truth):
        hit = next((t for t in free if cp <= t <= cp + delta), None)
        if hit is not None:
            free.remove(hit)
            hits.append(hit - cp)
    false = sum(not any(cp <= t <= cp + delta for cp in truth) for t in found)
    room = steps - len(truth) * (delta + 1)
    return (len(hits) / len(truth) if truth else None, false / room if room > 0 else (math.inf if false else 0.0), sum(hits) / len(hits) if hits else None, len(hits), false, len(found))


def test_metrics(spark):
    cases = [
        (200, [100], [50, 105, 110, 150]), (200, [50, 60], [62]), (200, [100], []), (10, [], [5]), (10, [5], [2]), (200, [100], [120]), (200, [100], [121]), (200, [10, 15, 20], [16, 17, 40]),
    ]
    rng = random.Random(0)
    cases += [(300, rng.sample(range(300), rng.randrange(5)), rng.sample(range(300), rng.randrange(9))) for _ in range(40)]
    lengths = spark.createDataFrame([(i, "d", c[0]) for i, c in enumerate(cases)], "s int, detector string, steps int")
    found = spark.createDataFrame([(i, "d", t) for i, c in enumerate(cases) for t in c[2]], "s int, detector string, t int")
    truth = spark.createDataFrame([(i, t) for i, c in enumerate(cases) for t in c[1]], "s int, cp int")
    got = {r.s: (r.tpr, r.fpr, r.add, r.n_tp, r.n_fp, r.n_detections) for r in metrics.evaluate(lengths, found, truth, ["detector", "s"], 20).collect()}
    for i, (steps, cps, hits) in enumerate(cases):
        want = match_reference(steps, 20, cps, hits)
        assert all(a == b or a == pytest.approx(b) for a, b in zip(got[i], want)), (cases[i], got[i], want)


def test_summaries(spark, tmp_path):
    rows = [("s1", "a", 1.0, 0.1, 5.0, 3), ("s1", "a", None, 0.3, None, 1), ("s2", "a", 0.5, 0.0, 7.0, 2), ("s1", "b", None, 0.2, None, 0), ("s2", "c", 1.0, 0.5, 2.0, 1)]
    df = spark.createDataFrame(rows, "scenario string, detector string, tpr double, fpr double, add double, n_detections int")
    s = metrics.summarise(df, ["scenario", "detector"])
    got = {(r.scenario, r.detector): r for r in s.collect()}
    assert (got["s1", "a"].tpr_mean, got["s1", "a"].tpr_std, got["s1", "a"].n_trials) == (1.0, 0.0, 2)
    assert got["s1", "b"].tpr_mean is None and got["s1", "b"].tpr_std is None
    assert {r.detector: r.tpr for r in metrics.overall(s, ["detector"]).collect()} == {"a": 0.75, "b": None, "c": 1.0}
    assert [r.detector for r in metrics.ranking(df, ["detector"]).orderBy("place").collect()] == ["c", "a", "b"]
    wide = {r.scenario: r for r in metrics.pivot_table(s, "scenario", "detector", ["a", "b", "c"]).collect()}
    assert wide["s1"]["a_tpr"] == "1.000" and wide["s1"]["b_tpr"] == "" and wide["s1"]["c_add"] == "" and wide["s2"]["c_add"] == "2.000"
    tall = {(r.scenario, r.metric): r for r in metrics.pivot_table(s, "scenario", "detector", ["a", "b", "c"], metric_rows=True).collect()}
    assert tall["s1", "tpr"]["a"] == "1.000" and tall["s2", "add"]["c"] == "2.000" and tall["s1", "add"]["b"] == "" and len(tall) == 6
    average = {(r.scenario, r.detector): r.tpr_mean for r in metrics.with_average(s, "scenario", ["detector"]).collect()}
    assert average["AVERAGE", "a"] == 0.75 and average["AVERAGE", "b"] is None and average["s2", "a"] == 0.5
    metrics.write_csv(s.limit(0), str(tmp_path / "none"))
    metrics.write_csv(s, str(tmp_path / "some"))
    assert spark.read.csv(str(tmp_path / "some"), header=True).count() == 4


# Sources


def test_generators(spark):
    made = generate(spark, list(SCENARIOS), [0, 1], steps=60, n=20, spacing=12)
    again = generate(spark, ["ba_hub_addition"], [1], steps=60, n=20, spacing=12)
    truth: dict = {}
    for r in made.truth.collect():
        truth.setdefault(r.series_id, []).append(r.cp)
    assert len(truth) == 18 and all(len(v) == (2 if "mixed" in s else 1) for s, v in truth.items())
    assert all(12 <= min(v) and max(v) <= 48 and (len(v) < 2 or abs(v[0] - v[1]) >= 12) for v in truth.values())
    assert made.snapshots.count() == 18 * 60
    m = {(r.series_id, r.t): r.m for r in graphs.counts(made.snapshots, made.edges).collect()}
    for s, up in (("er_density_increase", True), ("er_density_decrease", False), ("ba_parameter_shift", True), ("nws_k_parameter_shift", True), ("sbm_density_change", False)):
        (cp,) = truth[f"{s}/0"]
        before, after = np.mean([m[f"{s}/0", t] for t in range(cp)]), np.mean([m[f"{s}/0", t] for t in range(cp, 60)])
        assert (after > before) == up
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, made.edges.filter("series_id = 'ba_hub_addition/1'").collect()))
    with pytest.raises(ValueError):
        change_points(np.random.default_rng(0), 50, 2, 20)
    with pytest.raises(ValueError):
        generate(spark, ["nothing"], [0])


def test_detector_finds_generated_changes(spark):
    made = generate(spark, ["er_density_increase", "sbm_density_change"], [0, 1, 2], steps=100, n=20, spacing=30)
    x = graphs.extract(made.snapshots, made.edges)
    named = {"m": DetectorConfig(enable_horizon=False, threshold=20.0)}
    found = detect_many(x, named).filter("fired").select("series_id", "t")
    charts = control_chart(x, Cusum()).filter("fired").select("series_id", "t")
    lengths = x.groupBy("series_id").agg(F.count("*").cast("int").alias("steps"))
    for alarms in (found, charts):
        tpr = metrics.evaluate(lengths, alarms, made.truth, ["series_id"], 20).agg(F.avg("tpr")).first()[0]
        assert tpr >= 0.8


def test_contact_graphs(spark, tmp_path):
    head = "user.id,remote.user.id.if.known,time,prob2\n"
    lines = [
        "9,4,2008-09-19 10:00:00,0.5", "4,9,2008-09-19 11:00:00,NA", "9,9,2008-09-19 11:00:00,0.9", "9,NA,2008-09-19 12:00:00,0.9", "5,9,2008-09-21 00:00:00.5,0.2",
        "5,4,2008-09-18 23:59:59,0.9", "5,4,2009-07-05 00:00:00,0.9", "7,7,2008-09-20 01:00:00,0.9", "5,4,NA,0.9",
    ]
    (tmp_path / "log.csv").write_text(head + "\n".join(lines))
    log = read_csv(spark, str(tmp_path / "log.csv"))
    g = contact_graphs(log)
    assert [tuple(r) for r in g.nodes.orderBy("node").collect()] == [(0, 4), (1, 5), (2, 7), (3, 9)]
    assert sorted(tuple(r)[1:] for r in g.edges.collect()) == [(0, 0, 3), (2, 1, 3)]
    assert g.snapshots.count() == 289 and {r.n for r in g.snapshots.collect()} == {4}
    assert sorted(tuple(r)[1:] for r in contact_graphs(log, threshold=0.3).edges.collect()) == [(0, 0, 2)]
    assert [r.cp for r in labelled_days(spark).collect()] == [23, 68, 97, 173, 234]


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit("x").alias("_size")).repartition(7)
    got = dense_index(df.drop("_size"), "v", "i").collect()
    assert len(got) == 1000 and all(r.v == r.i for r in got)


def test_graph_forecast(spark):
    rng = np.random.default_rng(3)
    items = [("a", t, 8, erdos_renyi(0.4)(rng, 8)) for t in range(12)] + [("b", t, 5, []) for t in range(6)]
    snapshots, edges = frames(spark, items)
    spec = GraphForecast(0.5, 4)
    got: dict = {}
    for r in forecast_edges(snapshots, edges, spec).collect():
        got.setdefault((r.series_id, r.t), set()).add((r.u, r.v))
    assert all(s == "a" for s, _ in got)
    for t in range(3, 12):
        weight = np.zeros((8, 8))
        for j in range(4):
            for u, v in items[t - j][3]:
                weight[u, v] += 0.5 ** (j + 1)
        target = round(np.mean([len(items[t - j][3]) for j in range(4)]))
        order = sorted(((-round(weight[u, v], 12), u, v) for u in range(8) for v in range(u + 1, 8) if weight[u, v] > 0))
        assert got[("a", t)] == {(u, v) for _, u, v in order[:target]}
    x = forecast_features(snapshots, edges, spec)
    assert x.filter("series_id = 'a'").count() == 9 and x.filter("series_id = 'b'").first().x == [0.0] * 8
    found = detect(graphs.extract(snapshots, edges), DetectorConfig(startup_period=3, history_size=4), ahead=x).filter("series_id = 'a'").orderBy("t").collect()
    assert found[3].logm_hrzn is None and found[4].logm_hrzn is not None
    gaps = diagnostics(snapshots, edges, spec).filter("series_id = 'a'").collect()
    assert len(gaps) == 9 and all(r.sparsity_gap < 0.05 and r.degree_gap >= 0 for r in gaps)
    with pytest.raises(ValueError):
        GraphForecast(1.0)


# Streams


def test_streams(spark, tmp_path):
    rows = [(7, i % 2, datetime(2009, 1, 1) + timedelta(minutes=40 * (i // 3))) for i in range(30)] + [(1, 2, datetime(2009, 1, 9))]
    spark.createDataFrame(rows, "u int, r int, time timestamp").write.parquet(str(tmp_path / "in"))
    schema = "u int, r int, time timestamp"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = run_to_end(sessions_stream(stream(), "u", "time", 1800, "1 hour"), str(tmp_path / "s")).collect()
    assert len(got) == 10 and {r.n_events for r in got} == {3}
    days = run_to_end(daily_contacts_stream(stream(), "time", "u", "r", "1 hour"), str(tmp_path / "d")).collect()
    assert sorted((r.day, r.u, r.v, r.readings) for r in days) == [(104, 0, 7, 15), (104, 1, 7, 15)]


def test_detector_on_a_stream_of_several_batches(spark, tmp_path):
    config = DetectorConfig(threshold=6.0, startup_period=10, history_size=6, cooldown=3)
    stacks = {"s0": shifted(0, 40), "s1": shifted(1, 40)}
    whole = feature_frame(spark, stacks)
    batch = {(r.series_id, r.t): (r.logm_trad, r.logm_hrzn, r.fired) for r in detect(whole, config).collect()}
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = detect_stream(spark.readStream.schema(whole.schema).parquet(source), config)
    for low, high in ((0, 15), (15, 16), (10, 40)):  # the last part repeats steps, which are left out
        whole.filter(f"t >= {low} and t < {high}").coalesce(1).write.mode("append").parquet(source)
        run_to_end(stream, str(tmp_path / "out"))
    got = {(r.series_id, r.t): (r.logm_trad, r.logm_hrzn, r.fired) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()}
    assert set(got) == set(batch)
    for key, (a, h, fired) in batch.items():
        assert got[key][2] == fired
        assert all(x == y or x == pytest.approx(y) for x, y in zip(got[key][:2], (a, h)))


# The object interface and SQL functions


def test_detector_object(spark):
    made = generate(spark, ["er_density_increase"], [0], steps=80, n=15, spacing=25)
    few = graphs.DEFAULT[:2]
    result = Detector(startup_period=10, history_size=6, threshold=20.0).run(made.snapshots, made.edges, few)
    assert result.feature_names == ["mean_degree", "mean_clustering"]
    alarms = result.change_points.collect()
    assert alarms and all(r.driver in result.feature_names for r in alarms)
    parts = result.attribution().filter("t = 40").collect()
    assert sum(r.pct for r in parts) == pytest.approx(100.0) and {r.feature for r in parts} == set(result.feature_names)
    assert result.score(made.truth).first().tpr == 1.0
    assert result.wealth.filter("t = 10").first().m_traditional == pytest.approx(2 * 0.8)
    graph = Detector(startup_period=10, history_size=6, forecaster=GraphForecast(0.5, 6))
    assert graph.run(made.snapshots, made.edges, few).trace.filter("logm_hrzn is not null").count() == 70
    plain = Detector(DetectorConfig(startup_period=5)).run_on_features(result.features)
    assert plain.attribution("horizon").filter("t = 0").first().feature == "0"
    for bad, error in ((lambda: Detector(DetectorConfig(), threshold=1.0), TypeError), (lambda: graph.run_on_features(result.features), ValueError), (lambda: result.attribution("x"), ValueError)):
        with pytest.raises(error):
            bad()


def test_sql_functions(spark):
    assert "x_bet_default" in register(spark, "x_")
    row = spark.sql(
        "SELECT x_bet_default(0.5D) AS g, x_bet_power(NULL, 0.5D) AS n, x_log_bet(0.0D) AS l, x_theta(7, 'a|b', 3, 1) AS u, "
        "x_log_sum_exp(array(0.0D, 0.0D)) AS s, x_wealth_shares(array(1.0D, 1.0D)) AS w, x_wealth_shares(array(double('-inf'), double('-inf'))) AS v"
    ).first()
    assert row.g == pytest.approx(0.91511863) and row.n is None and row.l == pytest.approx(math.log(1e-300)) and row.u == theta_value(7, "a|b", 3, 1)
    assert row.s == pytest.approx(math.log(2)) and row.w == pytest.approx([50.0, 50.0]) and row.v == [50.0, 50.0]


def test_detector_as_a_table_function(spark):
    register(spark, "y_")
    stacks = {"s0": shifted(0, 40), "s1": shifted(1, 40)}
    frame = feature_frame(spark, stacks)
    frame.createOrReplaceTempView("y_features")
    config = DetectorConfig(threshold=6.0, startup_period=10, history_size=6, cooldown=3)
    want = {(r.series_id, r.t): (r.logm_trad, r.logm_hrzn, r.fired, r.fired_by) for r in detect(frame, config).collect()}
    rows = spark.sql("SELECT * FROM y_detect_changes(TABLE(y_features) PARTITION BY series_id ORDER BY (t), 6.0D, 10, 6, 5, 3)").collect()
    assert len(rows) == len(want)
    for r in rows:
        trad, hrzn, fired, by = want[(r.series_id, r.t)]
        assert (r.fired, r.fired_by) == (fired, by) and r.logm_trad == (trad if trad is None else pytest.approx(trad)) and r.logm_hrzn == (hrzn if hrzn is None else pytest.approx(hrzn))
