"""Graph snapshots and their scalar features.

``snapshots`` has a row ``(series_id, t, n)`` per snapshot (nodes 0..n-1),
``edges`` rows ``(series_id, t, u, v)`` in any orientation, with repeats and
loops; both are cleaned here. Counting features are plain joins and
aggregations. Features that need distances or spectra run in batches of
snapshots: each becomes a bit matrix, matrices of one size are stacked, and a
single batched product or eigen-decomposition serves the whole stack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.session import width

KEY = ["series_id", "t"]


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Each undirected edge of a snapshot once, as ``u < v``; loops and rows with nulls are left out."""
    u, v = F.least("u", "v"), F.greatest("u", "v")
    kept = edges.filter("series_id is not null and t is not null and u is not null and v is not null and u <> v")
    return kept.select("series_id", "t", u.cast("int").alias("u"), v.cast("int").alias("v")).dropDuplicates()


def counts(snapshots: DataFrame, edges: DataFrame) -> DataFrame:
    """``series_id, t, n, m, mean_degree, density`` of every snapshot, those without edges too (0 where undefined)."""
    m = canonical_edges(edges).groupBy(*KEY).agg(F.count(F.lit(1)).alias("m"))
    joined = snapshots.select(*KEY, "n").join(m, KEY, "left").withColumn("m", F.coalesce("m", F.lit(0)))
    n = F.col("n").cast("double")
    return joined.select(
        *KEY,
        "n",
        "m",
        F.when(n > 0, 2.0 * F.col("m") / n).otherwise(0.0).alias("mean_degree"),
        F.when(n > 1, 2.0 * F.col("m") / (n * (n - 1))).otherwise(0.0).alias("density"),
    )


def clustering(snapshots: DataFrame, edges: DataFrame) -> DataFrame:
    """``series_id, t, triangles, mean_clustering``: over all nodes, those of degree below 2 counting 0.

    Edges are directed from the node of smaller degree to that of larger degree
    (ties by id) before wedges are formed, so a hub's neighbours are never
    paired with each other: a node has at most sqrt(2 m) outgoing edges.
    """
    e = canonical_edges(edges)
    ends = e.select(*KEY, F.explode(F.array("u", "v")).alias("x"))
    degree = ends.groupBy(*KEY, "x").agg(F.count(F.lit(1)).alias("d"))
    ranked = e.join(degree.withColumnsRenamed({"x": "u", "d": "du"}), [*KEY, "u"]).join(degree.withColumnsRenamed({"x": "v", "d": "dv"}), [*KEY, "v"])
    first = F.struct("du", "u") < F.struct("dv", "v")
    out = ranked.select(*KEY, F.when(first, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = out.join(out.select(*KEY, "a", F.col("b").alias("c")), [*KEY, "a"]).filter("b < c")
    triangle = wedge.join(e.select(*KEY, F.col("u").alias("b"), F.col("v").alias("c")), [*KEY, "b", "c"])
    at_node = triangle.select(*KEY, F.explode(F.array("a", "b", "c")).alias("x")).groupBy(*KEY, "x").agg(F.count(F.lit(1)).alias("tri"))
    local = degree.join(at_node, [*KEY, "x"], "left").filter("d >= 2")
    per = local.groupBy(*KEY).agg(
        F.sum(2.0 * F.coalesce("tri", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).alias("c"), (F.sum(F.coalesce("tri", F.lit(0))) / 3).cast("bigint").alias("triangles")
    )
    return snapshots.select(*KEY, "n").join(per, KEY, "left").select(
        *KEY,
        F.coalesce("triangles", F.lit(0)).alias("triangles"),
        F.when(F.col("n") > 0, F.coalesce("c", F.lit(0.0)) / F.col("n")).otherwise(0.0).alias("mean_clustering"),
    )


def counted(snapshots: DataFrame, edges: DataFrame) -> DataFrame:
    """``series_id, t, x``: mean degree, mean clustering and density of every snapshot, by joins only, so for graphs of any size."""
    e = canonical_edges(edges)
    both = counts(snapshots, e).join(clustering(snapshots, e), KEY)
    return both.select(*KEY, F.array("mean_degree", "mean_clustering", "density").alias("x"))


@dataclass(frozen=True)
class Feature:
    """A named feature of a stack of adjacency matrices of one size; ``fn`` gets (B, n, n) and shared results, and returns (B,).

    ``sparse``, if there is one, gives the same for one large graph from its
    neighbours; without it a large graph becomes a matrix too.
    """

    name: str
    fn: Callable[[np.ndarray, dict], np.ndarray]
    sparse: Callable[[Neighbours], float] | None = None


class Neighbours:
    """One graph by its neighbour lists, for graphs whose matrix would be too large."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray) -> None:
        self.n, self.m = n, len(u)
        source, target = np.concatenate([u, v]).astype(np.int64), np.concatenate([v, u]).astype(np.int64)
        order = np.lexsort((target, source))
        self.source, self.target = source[order], target[order]
        self.degree = np.bincount(self.source, minlength=n)
        self._paths: tuple[np.ndarray, np.ndarray, int] | None = None

    def triangles(self) -> np.ndarray:
        """Triangles at each node; edges point to the end of larger degree, so a node has few of them to pair."""
        n, count = self.n, np.zeros(self.n, dtype=np.int64)
        rank = np.empty(n, dtype=np.int64)
        rank[np.lexsort((np.arange(n), self.degree))] = np.arange(n)
        out = rank[self.source] < rank[self.target]
        a, b = self.source[out], self.target[out]
        known = self.source * n + self.target
        ends = np.cumsum(np.bincount(a, minlength=n))
        later = ends[a] - np.arange(len(a)) - 1
        stops = np.append(np.searchsorted(np.cumsum(later), np.arange(PAIRS, later.sum() + PAIRS, PAIRS), side="right"), len(a)) if len(a) else [0]
        low = 0
        for high in np.unique(np.minimum(np.maximum(stops, 1), len(a))) if len(a) else ():
            first = np.repeat(np.arange(low, high), later[low:high])
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later[low:high]) - later[low:high], later[low:high])
            pair = b[first] * n + b[second]
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            closed = known[at] == pair
            for end in (a[first], b[first], b[second]):
                count += np.bincount(end[closed], minlength=n)
            low = high
        return count

    def paths(self) -> tuple[np.ndarray, np.ndarray, int]:
        """For each node how many others it reaches and the sum of their distances; and the sum of all inner nodes of shortest paths."""
        if self._paths is None:
            n = self.n
            reach, far, inner = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0
            touched = np.flatnonzero(self.degree)
            starts = (np.cumsum(self.degree) - self.degree)[touched]
            words = int(min(max(1, PATH_BYTES // (8 * max(2 * self.m, n, 1))), -(-max(len(touched), 1) // 64)))
            # A search per bit; as distances are symmetric, those that come to a node are those that it starts.
            for low in range(0, len(touched), 64 * words):
                block = touched[low : low + 64 * words]
                bit = np.arange(len(block))
                seen = np.zeros((n, words), dtype=np.uint64)
                seen[block, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
                front, hop = seen.copy(), 0
                while True:
                    hop += 1
                    near = np.zeros_like(seen)
                    near[touched] = np.bitwise_or.reduceat(front[self.target], starts, axis=0)
                    front = near & ~seen
                    found = np.bitwise_count(front).sum(axis=1, dtype=np.int64)
                    if not found.any():
                        break
                    seen |= front
                    reach += found
                    far += hop * found
                    inner += (hop - 1) * int(found.sum())
            self._paths = reach, far, inner
        return self._paths


#: Pairs of neighbours, and bytes of a block of searches, that are held at once.
PAIRS, PATH_BYTES = 4_000_000, 64_000_000
#: Graphs of more nodes than this are large.
DENSE_NODES = 4_096


def _distances(a: np.ndarray, shared: dict) -> np.ndarray:
    """Hop counts (B, n, n); -1 where unreachable."""
    if "distances" not in shared:
        b, n, _ = a.shape
        d = np.full((b, n, n), -1, dtype=np.int32)
        d[:, np.arange(n), np.arange(n)] = 0
        front = np.broadcast_to(np.eye(n, dtype=np.float32), a.shape)
        steps = a.astype(np.float32)
        for hop in range(1, n):
            front = ((front @ steps) > 0) & (d < 0)
            if not front.any():
                break
            d[front] = hop
            front = front.astype(np.float32)
        shared["distances"] = d
    return shared["distances"]


def _laplacian(a: np.ndarray, shared: dict) -> np.ndarray:
    """Eigenvalues of the Laplacians, ascending."""
    if "laplacian" not in shared:
        lap = -a.astype(np.float64)
        i = np.arange(a.shape[1])
        lap[:, i, i] = a.sum(axis=2)
        shared["laplacian"] = np.linalg.eigvalsh(lap)
    return shared["laplacian"]


def _zero(a: np.ndarray) -> np.ndarray:
    return np.zeros(len(a))


def mean_degree(a: np.ndarray, shared: dict) -> np.ndarray:
    return a.sum(axis=(1, 2)) / a.shape[1] if a.shape[1] else _zero(a)


def mean_clustering(a: np.ndarray, shared: dict) -> np.ndarray:
    if a.shape[1] == 0:
        return _zero(a)
    x = a.astype(np.float32)
    closed = np.einsum("bij,bij->bi", x @ x, x).astype(np.float64)
    d = a.sum(axis=2).astype(np.float64)
    pairs = d * (d - 1)
    return np.divide(closed, pairs, out=np.zeros_like(closed), where=pairs > 0).mean(axis=1)


def mean_betweenness(a: np.ndarray, shared: dict) -> np.ndarray:
    """Normalised betweenness, averaged.

    Summed over all nodes, the shortest paths between s and t contribute the
    number of inner nodes on one of them, whatever their number: distances suffice.
    """
    n = a.shape[1]
    if n < 3:
        return _zero(a)
    d = _distances(a, shared)
    return np.where(d > 0, d - 1, 0).sum(axis=(1, 2)) / (n * (n - 1.0) * (n - 2.0))


def mean_closeness(a: np.ndarray, shared: dict) -> np.ndarray:
    """Closeness within the reachable part, scaled by its size, averaged."""
    n = a.shape[1]
    if n < 2:
        return _zero(a)
    d = _distances(a, shared)
    reach = (d > 0).sum(axis=2).astype(np.float64)
    far = np.where(d > 0, d, 0).sum(axis=2).astype(np.float64)
    return (np.divide(reach, far, out=np.zeros_like(reach), where=far > 0) * reach / (n - 1)).mean(axis=1)


def mean_eigenvector(a: np.ndarray, shared: dict) -> np.ndarray:
    """Mean entry of the leading eigenvector (of length 1, of non-negative sum). Not unique if its eigenvalue is multiple."""
    if a.shape[1] == 0:
        return _zero(a)
    _, vectors = _adjacency(a, shared)
    return np.where(a.any(axis=(1, 2)), np.abs(vectors[:, :, -1].sum(axis=1)) / a.shape[1], 0.0)


def algebraic_connectivity(a: np.ndarray, shared: dict) -> np.ndarray:
    return _laplacian(a, shared)[:, 1] if a.shape[1] >= 2 else _zero(a)


def spectral_gap(a: np.ndarray, shared: dict) -> np.ndarray:
    """Third less second eigenvalue of the Laplacian."""
    return _laplacian(a, shared)[:, 2] - _laplacian(a, shared)[:, 1] if a.shape[1] >= 3 else _zero(a)


def _sparse_degree(g: Neighbours) -> float:
    return 2.0 * g.m / g.n if g.n else 0.0


def _sparse_density(g: Neighbours) -> float:
    return 2.0 * g.m / (g.n * (g.n - 1.0)) if g.n >= 2 else 0.0


def _sparse_clustering(g: Neighbours) -> float:
    pairs = g.degree * (g.degree - 1.0)
    return float(np.divide(2.0 * g.triangles(), pairs, out=np.zeros(g.n), where=pairs > 0).mean()) if g.n else 0.0


def _sparse_betweenness(g: Neighbours) -> float:
    return g.paths()[2] / (g.n * (g.n - 1.0) * (g.n - 2.0)) if g.n >= 3 else 0.0


def _sparse_closeness(g: Neighbours) -> float:
    if g.n < 2:
        return 0.0
    reach, far, _ = g.paths()
    return float((np.divide(reach, far, out=np.zeros(g.n), where=far > 0) * reach / (g.n - 1)).mean())


def density(a: np.ndarray, shared: dict) -> np.ndarray:
    n = a.shape[1]
    return a.sum(axis=(1, 2)) / (n * (n - 1.0)) if n >= 2 else _zero(a)


def _adjacency(a: np.ndarray, shared: dict) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the adjacency matrices, ascending, and their vectors."""
    if "adjacency" not in shared:
        shared["adjacency"] = np.linalg.eigh(a.astype(np.float64))
    return shared["adjacency"]


def laplacian_sum(a: np.ndarray, shared: dict) -> np.ndarray:
    """Sum of the Laplacian's eigenvalues: twice the edges."""
    return _laplacian(a, shared).sum(axis=1)


def laplacian_squares(a: np.ndarray, shared: dict) -> np.ndarray:
    """Sum of their squares: degrees and their squares."""
    return (_laplacian(a, shared) ** 2).sum(axis=1)


def connected(a: np.ndarray, shared: dict) -> np.ndarray:
    """Whether the second eigenvalue is above 0, as it is for connected graphs only (a single node is connected)."""
    return (_laplacian(a, shared)[:, 1] > 1e-9).astype(np.float64) if a.shape[1] >= 2 else np.ones(len(a))


def adjacency_squares(a: np.ndarray, shared: dict) -> np.ndarray:
    """Sum of the squares of the adjacency matrix' eigenvalues: twice the edges."""
    return (_adjacency(a, shared)[0] ** 2).sum(axis=1)


def adjacency_cubes(a: np.ndarray, shared: dict) -> np.ndarray:
    """Sum of their cubes: six times the triangles."""
    return (_adjacency(a, shared)[0] ** 3).sum(axis=1)


def leading_residual(a: np.ndarray, shared: dict) -> np.ndarray:
    """How far the leading vector is from being an eigenvector of length 1."""
    if a.shape[1] == 0:
        return _zero(a)
    values, vectors = _adjacency(a, shared)
    v = vectors[:, :, -1]
    return np.abs((a @ v[:, :, None])[:, :, 0] - values[:, -1:] * v).max(axis=1) + np.abs((v**2).sum(axis=1) - 1.0)


def triangle_count(a: np.ndarray, shared: dict) -> np.ndarray:
    """Triangles per node on average; an example of a feature of one's own."""
    x = a.astype(np.float32)
    return np.einsum("bij,bij->b", x @ x, x).astype(np.float64) / 2.0 / max(a.shape[1], 1)


#: The default features; their order is the order of a feature vector.
DEFAULT = tuple(
    Feature(f.__name__, f, sparse)
    for f, sparse in (
        (mean_degree, _sparse_degree), (mean_clustering, _sparse_clustering), (mean_betweenness, _sparse_betweenness), (mean_closeness, _sparse_closeness),
        (mean_eigenvector, None), (algebraic_connectivity, None), (spectral_gap, None), (density, _sparse_density),
    )
)


def names(features: tuple[Feature, ...] = DEFAULT) -> list[str]:
    """The features' names, in order."""
    return [f.name for f in features]


def extract(snapshots: DataFrame, edges: DataFrame, features: tuple[Feature, ...] = DEFAULT) -> DataFrame:
    """``series_id, t, x``: the feature vector of every snapshot, those without edges too.

    An edge to a node at or beyond ``n`` is an error. A snapshot is one task's
    work; the snapshots of a series lie in many tasks. Snapshots of up to
    ``DENSE_NODES`` nodes become matrices, stacked; of larger ones only the
    features without a sparse form (spectra) need the matrix.
    """
    lists = canonical_edges(edges).groupBy(*KEY).agg(F.collect_list(F.struct("u", "v")).alias("e"))
    rows = snapshots.select("series_id", "t", F.col("n").cast("int").alias("n")).join(lists, KEY, "left")
    rows = rows.select("series_id", "t", "n", F.col("e.u").alias("u"), F.col("e.v").alias("v"))
    rows = rows.repartition(width(snapshots.sparkSession), *KEY)
    schema = f"series_id {dict(rows.dtypes)['series_id']}, t {dict(rows.dtypes)['t']}, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield _extract_batch(batch.slice(at, 1024), features)

    return rows.mapInArrow(run, schema)


def _extract_batch(batch: pa.RecordBatch, features: tuple[Feature, ...]) -> pa.RecordBatch:
    sizes = batch.column(2).to_numpy(zero_copy_only=False)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(batch.column(3)), 0))
    u, v = (pc.list_flatten(batch.column(i)).to_numpy(zero_copy_only=False) for i in (3, 4))
    ends = np.cumsum(lengths)
    x = np.zeros((batch.num_rows, len(features)))
    for row in np.flatnonzero(sizes > DENSE_NODES):
        part = slice(ends[row] - lengths[row], ends[row])
        if lengths[row] and max(u[part].max(), v[part].max()) >= sizes[row]:
            raise IndexError(f"an edge ends at or beyond the {sizes[row]} nodes")
        graph, shared, a = Neighbours(int(sizes[row]), u[part], v[part]), {}, None
        for k, f in enumerate(features):
            if f.sparse is not None:
                x[row, k] = f.sparse(graph)
                continue
            if a is None:
                a = np.zeros((1, graph.n, graph.n), dtype=np.int8)
                a[0, u[part], v[part]] = a[0, v[part], u[part]] = 1
            x[row, k] = f.fn(a, shared)[0]
    for n in np.unique(sizes[sizes <= DENSE_NODES]):
        same = np.flatnonzero(sizes == n)
        step = max(1, int(4e6 // max(int(n) ** 2, 1)))
        for at in range(0, len(same), step):
            group = same[at : at + step]
            a = np.zeros((len(group), n, n), dtype=np.int8)
            for i, row in enumerate(group):
                part = slice(ends[row] - lengths[row], ends[row])
                a[i, u[part], v[part]] = a[i, v[part], u[part]] = 1
            shared: dict = {}
            for k, f in enumerate(features):
                x[group, k] = f.fn(a, shared)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(features), pa.int32()), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["series_id", "t", "x"])
