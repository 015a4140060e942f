"""How well alarms match true change points, per series and over trials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def evaluate(lengths: DataFrame, alarms: DataFrame, truth: DataFrame, by: list[str], delta: int = 20) -> DataFrame:
    """``*by, tpr, fpr, add, n_tp, n_fp, n_detections`` for every row of ``lengths`` (``*by, steps``).

    ``alarms`` has ``*by, t``, ``truth`` ``*by, cp`` (or the series columns of
    ``by`` only, if truths are shared by several detectors). Truths in order of
    time each take the earliest alarm not yet taken in ``[cp, cp + delta]``. An
    alarm in no such window is false; one in a window but not taken is neither.

    tpr is null without truths, add (the mean delay of the hits) without hits.
    fpr divides by the steps outside the windows; if there are none it is 0 or,
    with false alarms, infinite.

    The alarms and truths of one trial form two sorted arrays; the matching is
    one fold over the truths, so overlapping windows are matched right.
    """
    shared = [c for c in by if c in truth.columns]
    a = alarms.groupBy(*by).agg(F.array_sort(F.collect_list("t")).alias("alarms"))
    c = truth.groupBy(*shared).agg(F.array_sort(F.collect_list("cp")).alias("truths"))
    none = F.array().cast("array<int>")
    rows = lengths.join(a, by, "left").join(c, shared, "left")
    rows = rows.select(*by, "steps", F.coalesce(F.col("alarms").cast("array<int>"), none).alias("a"), F.coalesce(F.col("truths").cast("array<int>"), none).alias("c"))

    # The next free alarm only ever moves forward: alarms before a truth are of no use to later truths.
    def match(s, cp):
        rest = F.filter(s["rest"], lambda t: t >= cp)
        hit = F.coalesce(F.get(rest, F.lit(0)) <= cp + delta, F.lit(False))
        return F.struct(
            F.when(hit, F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest).alias("rest"),
            (s["tp"] + hit.cast("int")).alias("tp"),
            (s["delay"] + F.when(hit, F.get(rest, F.lit(0)) - cp).otherwise(0)).alias("delay"),
        )

    start = F.struct(F.col("a").alias("rest"), F.lit(0).alias("tp"), F.lit(0).alias("delay"))
    rows = rows.withColumn("m", F.aggregate("c", start, match))
    in_window = lambda t: F.exists("c", lambda cp: (t >= cp) & (t <= cp + delta))
    rows = rows.withColumn("n_fp", F.size(F.filter("a", lambda t: ~in_window(t))))
    free = F.col("steps") - F.size("c") * (delta + 1)
    return rows.select(
        *by,
        F.when(F.size("c") > 0, F.col("m.tp") / F.size("c")).alias("tpr"),
        F.when(free > 0, F.col("n_fp") / F.when(free > 0, free)).when(F.col("n_fp") == 0, 0.0).otherwise(F.lit(float("inf"))).alias("fpr"),
        F.when(F.col("m.tp") > 0, F.col("m.delay") / F.when(F.col("m.tp") > 0, F.col("m.tp"))).alias("add"),
        F.col("m.tp").alias("n_tp"),
        "n_fp",
        F.size("a").alias("n_detections"),
    )


def summarise(trials: DataFrame, by: list[str]) -> DataFrame:
    """``*by, n_trials`` and mean and standard deviation of tpr, fpr and add (nulls left out; 0 for one value), ``n_detections_mean``."""
    parts = []
    for m in ("tpr", "fpr", "add"):
        parts += [F.avg(m).alias(f"{m}_mean"), F.when(F.count(m) > 0, F.coalesce(F.stddev_samp(m), F.lit(0.0))).alias(f"{m}_std")]
    return trials.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trials"), *parts, F.avg("n_detections").alias("n_detections_mean"))


def overall(summary: DataFrame, by: list[str]) -> DataFrame:
    """The mean over scenarios of their means, per ``by``."""
    return summary.groupBy(*by).agg(*[F.avg(f"{m}_mean").alias(m) for m in ("tpr", "fpr", "add")])


def ranking(trials: DataFrame, by: list[str]) -> DataFrame:
    """Configurations from best to worst: by mean tpr, then by mean add (none last)."""
    means = trials.groupBy(*by).agg(*[F.avg(m).alias(m) for m in ("tpr", "fpr", "add")])
    order = W.orderBy(F.desc_nulls_last("tpr"), F.asc_nulls_last("add"), *by)
    # One row per configuration is ranked: as many as were configured.
    return means.withColumn("place", F.row_number().over(order))


def pivot_table(
    summary: DataFrame, row: str, column: str, values: list[str], metrics: tuple[str, ...] = ("tpr", "fpr", "add"), metric_rows: bool = False
) -> DataFrame:
    """One row per ``row`` and a column ``<value>_<metric>`` each; with ``metric_rows`` one row per ``row`` and metric and a column per value.

    Numbers have three decimals; a cell without one is empty.
    """
    if metric_rows:
        long = summary.select(row, column, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("value")) for m in metrics])))
        wide, keys = long.groupBy(row, "metric").pivot(column, values).agg(F.first("value", ignorenulls=True)), [row, "metric"]
    else:
        means = [F.first(F.col(f"{m}_mean"), ignorenulls=True).alias(m) for m in metrics]
        wide, keys = summary.groupBy(row).pivot(column, values).agg(*means), [row]
    cell = lambda c: F.when(F.col(f"`{c}`").isNull(), "").otherwise(F.format_string("%.3f", F.col(f"`{c}`"))).alias(c)
    return wide.select(*keys, *[cell(c) for c in wide.columns if c not in keys])


def with_average(summary: DataFrame, scenario: str, by: list[str]) -> DataFrame:
    """The scenarios' means and, as one more scenario ``AVERAGE``, the means over them."""
    names = [f"{m}_mean" for m in ("tpr", "fpr", "add")]
    average = summary.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names]).select(F.lit("AVERAGE").alias(scenario), *by, *names)
    return summary.select(scenario, *by, *names).unionByName(average)


def write_csv(table: DataFrame, path: str) -> None:
    """One CSV folder with a header; a table without rows still gets one."""
    table.write.mode("overwrite").csv(path, header=True, emptyValue="")
