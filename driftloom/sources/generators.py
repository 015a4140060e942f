"""Synthetic graph sequences with known change points.

Four public random-graph models, nine named scenarios. A sequence is a pure
function of (scenario, seed), so sequences are generated where they are needed:
one row of a small table per sequence, expanded in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.session import width

Sampler = Callable[[np.random.Generator, int], np.ndarray]


def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def erdos_renyi(p: float) -> Sampler:
    """Every pair with probability p."""

    def sample(rng: np.random.Generator, n: int) -> np.ndarray:
        u, v = _pairs(n)
        keep = rng.random(len(u)) < p
        return np.stack([u[keep], v[keep]], axis=1)

    return sample


def two_blocks(inside: float, between: float) -> Sampler:
    """Two blocks of half the nodes each; pairs inside a block and between blocks with their own probabilities."""

    def sample(rng: np.random.Generator, n: int) -> np.ndarray:
        u, v = _pairs(n)
        half = n // 2
        keep = rng.random(len(u)) < np.where((u < half) == (v < half), inside, between)
        return np.stack([u[keep], v[keep]], axis=1)

    return sample


def preferential_attachment(m: int) -> Sampler:
    """Nodes join one by one and link to m distinct earlier nodes, chosen in proportion to their degrees."""

    def sample(rng: np.random.Generator, n: int) -> np.ndarray:
        if not 1 <= m < n:
            raise ValueError("m must lie between 1 and n - 1")
        # The first joiner links to all m founders; afterwards a node is listed once per link end.
        edges = [(i, m) for i in range(m)]
        ends = [x for e in edges for x in e]
        for node in range(m + 1, n):
            chosen: set[int] = set()
            while len(chosen) < m:
                chosen.add(ends[rng.integers(len(ends))])
            edges += [(x, node) for x in sorted(chosen)]
            ends += [y for x in sorted(chosen) for y in (x, node)]
        return np.array(edges, dtype=np.int64)

    return sample


def small_world(k: int, p: float) -> Sampler:
    """A ring where each node links to its k nearest, plus for each ring link, with probability p, a random chord."""

    def sample(rng: np.random.Generator, n: int) -> np.ndarray:
        if k >= n:
            raise ValueError("k must be below n")
        i = np.repeat(np.arange(n), k // 2)
        j = (i + np.tile(np.arange(1, k // 2 + 1), n)) % n
        a = np.zeros((n, n), dtype=bool)
        a[i, j] = a[j, i] = True
        for u in i[rng.random(len(i)) < p]:
            if a[u].sum() >= n - 1:
                continue
            w = int(rng.integers(n))
            while w == u or a[u, w]:
                w = int(rng.integers(n))
            a[u, w] = a[w, u] = True
        u, v = np.nonzero(np.triu(a))
        return np.stack([u, v], axis=1)

    return sample


#: The regimes of each scenario, one more than its change points.
SCENARIOS: dict[str, tuple[Sampler, ...]] = {
    "sbm_community_merge": (two_blocks(0.95, 0.01), two_blocks(0.70, 0.15)),
    "sbm_density_change": (two_blocks(0.95, 0.01), two_blocks(0.50, 0.05)),
    "sbm_mixed_changes": (two_blocks(0.95, 0.01), two_blocks(0.70, 0.15), two_blocks(0.40, 0.05)),
    "er_density_increase": (erdos_renyi(0.05), erdos_renyi(0.30)),
    "er_density_decrease": (erdos_renyi(0.30), erdos_renyi(0.05)),
    "ba_parameter_shift": (preferential_attachment(1), preferential_attachment(4)),
    "ba_hub_addition": (preferential_attachment(1), preferential_attachment(6)),
    "nws_rewiring_increase": (small_world(6, 0.05), small_world(6, 0.15)),
    "nws_k_parameter_shift": (small_world(4, 0.10), small_world(8, 0.10)),
}


def change_points(rng: np.random.Generator, steps: int, count: int, spacing: int, tries: int = 10_000) -> list[int]:
    """``count`` sorted steps in [spacing, steps - spacing], at least ``spacing`` apart."""
    if count and (spacing > steps - spacing or (count - 1) * spacing > steps - 2 * spacing):
        raise ValueError(f"{count} change points at least {spacing} apart don't fit into {steps} steps")
    for _ in range(tries):
        points = np.sort(rng.integers(spacing, steps - spacing + 1, size=count))
        if count < 2 or np.diff(points).min() >= spacing:
            return [int(x) for x in points]
    raise ValueError("no change points found that are far enough apart")


@dataclass(frozen=True)
class Sequences:
    """``snapshots`` (series_id, t, n), ``edges`` (series_id, t, u, v), ``truth`` (series_id, cp); all lazy."""

    snapshots: DataFrame
    edges: DataFrame
    truth: DataFrame


def generate(spark: SparkSession, scenarios: list[str], seeds: list[int], steps: int = 200, n: int = 50, spacing: int = 40) -> Sequences:
    """A sequence per scenario and seed; its id is ``<scenario>/<seed>``.

    Change points are drawn first, then the snapshots in order of time, each a
    fresh graph of its regime, all from one generator per sequence: the same
    scenario and seed give the same sequence under any partitioning.
    """
    for s in scenarios:
        if s not in SCENARIOS:
            raise ValueError(f"unknown scenario {s!r}; one of {sorted(SCENARIOS)} is expected")
    units = spark.createDataFrame([(s, int(x)) for s in scenarios for x in seeds], "scenario string, seed bigint")
    units = units.repartition(min(width(spark), len(scenarios) * len(seeds)))

    order = sorted(SCENARIOS)

    def begin(unit: dict) -> tuple[np.random.Generator, list[int]]:
        rng = np.random.default_rng([order.index(unit["scenario"]), unit["seed"]])
        return rng, change_points(rng, steps, len(SCENARIOS[unit["scenario"]]) - 1, spacing)

    def points_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The generator's first draws: no graph has to be drawn for them.
        for batch in batches:
            found = [(f"{unit['scenario']}/{unit['seed']}", cp) for unit in batch.to_pylist() for cp in begin(unit)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.string()), pa.array([cp for _, cp in found], pa.int32())], names=["series_id", "cp"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                regimes = SCENARIOS[unit["scenario"]]
                rng, points = begin(unit)
                parts = [(t, regimes[np.searchsorted(points, t, side="right")](rng, n)) for t in range(steps)]
                t = np.concatenate([np.full(len(e), t, dtype=np.int32) for t, e in parts])
                uv = np.concatenate([e for _, e in parts]).astype(np.int32)
                name = pa.array([f"{unit['scenario']}/{unit['seed']}"] * len(t))
                yield pa.RecordBatch.from_arrays([name, pa.array(t), pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["series_id", "t", "u", "v"])

    edges = units.mapInArrow(expand, "series_id string, t int, u int, v int")
    truth = units.mapInArrow(points_only, "series_id string, cp int")
    series = units.select(F.concat_ws("/", "scenario", F.col("seed").cast("string")).alias("series_id"))
    snapshots = series.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t"), F.lit(n).alias("n"))
    return Sequences(snapshots, edges, truth)
