"""Work per key when few keys hold most rows: fragment and replicate by load.

Keys are packed into tasks by their measured load. A key above a task's fair
share is split into shards in proportion to its load; the other side of a join
is copied to those shards only, every other key stays whole in one task. The
plan names only the keys above the share: by arithmetic at most
``tasks * per_task`` of them exist, whatever the data, so that list (and only
that) may live on the driver and be broadcast.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.session import cut, width, written


@dataclass(frozen=True)
class ShardPlan:
    """Where the heavy keys' shards go; every other key is placed by its hash."""

    n_tasks: int
    key_type: str
    #: (key, tasks of its shards in order)
    heavy: tuple[tuple[object, tuple[int, ...]], ...]

    def _table(self, df: DataFrame) -> DataFrame:
        rows = [(k, list(t)) for k, t in self.heavy]
        return df.sparkSession.createDataFrame(rows, f"plan_key {self.key_type}, plan_tasks array<int>")

    def _light(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n_tasks)).cast("int")

    def fragment(self, df: DataFrame, key: str, by: list[str]) -> DataFrame:
        """``df`` with ``task_id``: a heavy key's rows are dealt to its shards by the hash of the columns ``by``, those of a null key to all tasks."""
        anywhere = F.pmod(F.xxhash64(*[F.col(c) for c in by], F.lit(2)), F.lit(self.n_tasks)).cast("int")
        light = F.when(F.col(key).isNull(), anywhere).otherwise(self._light(F.col(key)))
        if not self.heavy:
            return df.withColumn("task_id", light)
        deal = F.pmod(F.xxhash64(*[F.col(c) for c in by], F.lit(1)), F.size("plan_tasks")).cast("int")
        joined = df.join(F.broadcast(self._table(df)), F.col(key).eqNullSafe(F.col("plan_key")), "left")
        task = F.coalesce(F.get("plan_tasks", deal), light)
        return joined.withColumn("task_id", task).drop("plan_key", "plan_tasks")

    def replicate(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` with ``task_id``: a heavy key's rows are copied to each task that has a shard of it."""
        if not self.heavy:
            return df.withColumn("task_id", self._light(F.col(key)))
        joined = df.join(F.broadcast(self._table(df)), F.col(key).eqNullSafe(F.col("plan_key")), "left")
        tasks = F.coalesce(F.array_distinct("plan_tasks"), F.array(self._light(F.col(key))))
        return joined.withColumn("task_id", F.explode(tasks)).drop("plan_key", "plan_tasks")


def plan_shards(loads: DataFrame, key: str, load: str, n_tasks: int, per_task: int = 4) -> ShardPlan:
    """Pack keys into ``n_tasks`` tasks by their loads (one row per key in ``loads``).

    A key above the share ``total / (n_tasks * per_task)`` is heavy: it gets
    ``ceil(load / share)`` shards, at most one per task. Shards go, largest
    first, to the least loaded task; the light keys count as spread evenly.
    """
    if n_tasks < 1 or per_task < 1:
        raise ValueError("n_tasks and per_task must be positive")
    total = loads.agg(F.sum(load)).first()[0] or 0
    share = total / (n_tasks * per_task)
    heavy = loads.filter(F.col(load) > F.lit(share)).select(key, load)
    # At most n_tasks * per_task rows: each exceeds that fraction of the total.
    found = sorted(((r[0], int(r[1])) for r in heavy.collect()), key=lambda x: (-x[1], str(x[0])))
    rest = (total - sum(x for _, x in found)) / n_tasks
    pieces = []
    for k, (_, size) in enumerate(found):
        shards = min(n_tasks, max(1, math.ceil(size / share)))
        pieces += [(size / shards, k)] * shards
    tasks: list[list[int]] = [[] for _ in found]
    queue = [(rest, t) for t in range(n_tasks)]
    for size, k in sorted(pieces, key=lambda x: (-x[0], x[1])):
        filled, t = heapq.heappop(queue)
        heapq.heappush(queue, (filled + size, t))
        tasks[k].append(t)
    return ShardPlan(n_tasks, dict(loads.dtypes)[key], tuple((k, tuple(t)) for (k, _), t in zip(found, tasks)))


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, by: list[str], plan: ShardPlan, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key`` under ``plan``; null keys match nothing.

    ``left`` is fragmented by ``by`` (columns that tell its rows apart),
    ``right`` is replicated to the shards. Both sides are sent straight to the
    task that the plan names, so a busy key's join runs in as many tasks as its
    load asks for. ``how`` is ``inner`` or ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    sent = plan.fragment(left, key, by).repartitionById(plan.n_tasks, F.col("task_id"))
    copies = plan.replicate(right.filter(F.col(key).isNotNull()), key).repartitionById(plan.n_tasks, F.col("task_id"))
    return sent.join(copies.hint("shuffle_hash"), ["task_id", key], how).drop("task_id")


def per_key_results(log: DataFrame, ends: tuple[str, str], time: str, value: str, n_tasks: int | None = None) -> DataFrame:
    """Results for every value of each of the two columns ``ends`` of a contact log.

    Returns ``field`` (the column), ``key_id``, ``readings``, ``share`` (of the
    rows whose ``field`` isn't null), ``partners`` (distinct non-null values of
    the other column), ``first_time``, ``last_time`` and ``mean_value``.

    Rows are combined per pair of ends on the map side before the first
    exchange, and the pairs are written once. They are the fragmented side, dealt to a heavy key's shards
    by partner, so a key's distinct partners add up over its shards; the table
    of loads per key is the matching side, replicated to those shards. The last
    step combines at most one row per key and task.

    Defined cases: a null end has no result of its own and is no partner, but its
    row counts for the other end; null times and values are left out of their
    results (null if none is left), NaN values count as null; self-contacts
    count like others; repeated rows count each; an empty table yields no row;
    other columns, whatever their names, are ignored.
    """
    n_tasks = n_tasks or width(log.sparkSession)
    a, b = ends
    number = F.col(value).cast("double")
    rows = log.select(
        F.col(a).alias("a"), F.col(b).alias("b"), F.col(time).alias("t"), F.when(~F.isnan(number), number).alias("v")
    )
    fields = [F.lit(x.strip("`")) for x in ends]
    # The log is read once: a row per pair of ends is written, and all else is computed from these.
    pairs = written(
        rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.sum("v").alias("s"), F.count("v").alias("nv"))
    )
    ends_of = F.array(*[F.struct(F.struct(f.alias("field"), F.col(c).alias("key_id")).alias("place"), F.col("n")) for f, c in zip(fields, "ab")])
    loads = pairs.select(F.inline(ends_of)).filter(F.col("place.key_id").isNotNull()).groupBy("place").agg(F.sum("n").alias("load"))
    loads = cut(loads)  # one row per key; read by the plan, the totals and the join
    plan = plan_shards(loads, "place", "load", n_tasks)
    totals = dict(loads.groupBy("place.field").agg(F.sum("load")).collect())  # two rows

    kept = [F.col(c) for c in ("n", "lo", "hi", "s", "nv")]
    sides = F.array(
        F.struct(F.struct(fields[0].alias("field"), F.col("a").alias("key_id")).alias("place"), F.col("b").alias("partner"), *kept),
        F.struct(F.struct(fields[1].alias("field"), F.col("b").alias("key_id")).alias("place"), F.col("a").alias("partner"), *kept),
    )
    per_side = pairs.select(F.inline(sides)).filter(F.col("place.key_id").isNotNull())
    matched = fragment_replicate_join(per_side, loads, "place", ["partner"], plan)
    partial = matched.groupBy("place").agg(
        F.sum("n").alias("readings"),
        F.max("load").alias("load"),
        F.count("partner").alias("partners"),
        F.min("lo").alias("first_time"),
        F.max("hi").alias("last_time"),
        F.sum("s").alias("s"),
        F.sum("nv").alias("nv"),
    )
    of = F.lit(None).cast("bigint")
    for name, rows_of in totals.items():
        of = F.when(F.col("place.field") == name, F.lit(rows_of)).otherwise(of)
    return partial.select(
        F.col("place.field").alias("field"),
        F.col("place.key_id").alias("key_id"),
        "readings",
        (F.col("load") / of).alias("share"),
        "partners",
        "first_time",
        "last_time",
        F.when(F.col("nv") > 0, F.col("s") / F.col("nv")).alias("mean_value"),
    )
