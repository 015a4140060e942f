"""Per-series kernels: whole series as arrays, stacked by shape, a batch at a time.

A series is gathered once, as one array of its steps (one exchange on the series
key, after which nothing moves any more). Kernels get stacks (B, T, K) of series
of equal shape, so that a loop over T serves B series at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.session import width

#: At most so many numbers of one stack.
STACK = 1_000_000


def clean_features(features: DataFrame, order: str) -> DataFrame:
    """``series_id, t, x`` with one sound row per step.

    Of repeated rows of a step the last by ``order`` counts, one with a vector
    before one without. A null or NaN element, and every element of a missing
    vector, takes the feature's last known value before it in its series, or 0
    if there is none. Rows without series or step, and series without any
    vector, are left out.
    """
    rows = features.filter("series_id is not null and t is not null")
    best = F.max(F.struct(F.col("x").isNotNull().alias("has"), F.col(order).alias("at"), "x")).getField("x")
    rows = rows.groupBy("series_id", "t").agg(best.alias("x"))
    size = F.max(F.size("x")).over(W.partitionBy("series_id"))
    blank = F.array_repeat(F.lit(None).cast("double"), F.col("size"))
    rows = rows.withColumn("size", size).filter("size > 0").withColumn("x", F.coalesce("x", blank))
    long = rows.select("series_id", "t", F.posexplode("x").alias("k", "v"))
    known = F.when(~F.isnan("v"), F.col("v"))
    so_far = W.partitionBy("series_id", "k").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    long = long.withColumn("v", F.coalesce(F.last(known, ignorenulls=True).over(so_far), F.lit(0.0)))
    whole = long.groupBy("series_id", "t").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("x"))
    return whole.select("series_id", "t", F.col("x.v").alias("x"))


def per_series(features: DataFrame, kernel: Callable[[list, np.ndarray, np.ndarray, np.ndarray | None], dict], fields: str, ahead: DataFrame | None = None) -> DataFrame:
    """Run ``kernel(names, t, x, ahead)`` on stacks of series.

    ``names`` are B series, ``t`` is (B, T), ``x`` and ``ahead`` (B, T, K). The
    kernel returns columns by name: (B, T) or (B, T, K) arrays, masked where
    null, of the same number of leading copies C (C, B, T, ..) each. ``fields``
    is the schema of those columns, which follow ``series_id, t``.
    """
    rows = features.select("series_id", "t", "x")
    if ahead is not None:
        rows = rows.join(ahead.select("series_id", "t", F.col("x").alias("ahead")), ["series_id", "t"], "left")
    names = [c for c in rows.columns if c != "series_id"]
    spread = rows.repartition(width(features.sparkSession), "series_id")
    series = spread.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("steps"))
    series = series.select("series_id", *[F.col(f"steps.{n}").alias(n) for n in names])
    kinds = dict(rows.dtypes)
    schema = f"series_id {kinds['series_id']}, t {kinds['t']}, {fields}"
    guessed = ahead is not None  # the closure must not hold the frame itself
    step_type = pa.from_numpy_dtype(np.dtype({"int": "int32", "bigint": "int64", "smallint": "int16", "tinyint": "int8"}[kinds["t"]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            t_flat = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False)
            vectors = pc.list_flatten(batch.column(2))
            sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            at = np.cumsum(sizes) - sizes
            x_flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
            widths = sizes[starts] if len(starts) else sizes
            ids = batch.column(0).to_pylist()
            other = batch.column(3).to_pylist() if guessed else None
            for T, K in {(int(a), int(b)) for a, b in zip(lengths, widths)}:
                alike = np.flatnonzero((lengths == T) & (widths == K))
                step = max(1, STACK // max(T * K, 1))
                for lo in range(0, len(alike), step):
                    group = alike[lo : lo + step]
                    place = starts[group][:, None] + np.arange(T)[None, :]
                    if (sizes[place] != K).any():
                        raise ValueError("the vectors of a series differ in length")
                    x = x_flat[at[place][:, :, None] + np.arange(K)[None, None, :]]
                    guess = None
                    if other is not None:
                        guess = np.array([[v if v is not None else [np.nan] * K for v in other[g]] for g in group], dtype=np.float64)
                    out = kernel([ids[g] for g in group], t_flat[place], x, guess)
                    yield _rows(batch.column(0).take(pa.array(group)), t_flat[place].astype(step_type.to_pandas_dtype()), out)

    return series.mapInArrow(run, schema)


def _rows(ids: pa.Array, t: np.ndarray, out: dict) -> pa.RecordBatch:
    """Flatten the columns of a stack, copy by copy."""
    copies = next(iter(out.values())).shape[0]
    b, steps = t.shape
    owner = np.tile(np.repeat(np.arange(b), steps), copies)
    columns, names = [ids.take(pa.array(owner)), pa.array(np.tile(t.ravel(), copies))], ["series_id", "t"]
    for name, values in out.items():
        names.append(name)
        data, mask = np.ma.getdata(values), np.ma.getmaskarray(values)
        if values.ndim == 3:
            columns.append(pa.array(data.reshape(-1), mask=mask.reshape(-1)))
        else:
            k = values.shape[3]
            flat = pa.array(data.reshape(-1), mask=mask.reshape(-1))
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(copies * b * steps + 1) * k, pa.int32()), flat))
    return pa.RecordBatch.from_arrays(columns, names=names)
