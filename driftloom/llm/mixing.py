"""Sources mixed to target weights by weighted fair queueing.

Each source is a queue: its documents in an order shuffled by hash, passed as
often as repeats are allowed. A document's virtual finish time is the number of
its source's tokens up to and including it, divided by the source's weight.
Taking documents in order of virtual finish serves every source in proportion
to its weight; the mixture ends where the budget is used up. Once a source has
no document left the others share its part.

The running sums are computed in two steps, so that no source has to pass
through one task: within ranges of the shuffle hash, and over the ranges'
totals. The end of the mixture is found on histograms of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.session import cut

#: Sources are few by nature (they have target shares); their table is checked against this before it is used as a small one.
MOST_SOURCES = 10_000
BINS = 4_096


@dataclass(frozen=True)
class Mixture:
    """The documents taken, in order, and what each source contributed."""

    documents: DataFrame
    shares: DataFrame


@dataclass(frozen=True)
class _Source:
    name: str
    weight: float
    repeats: int
    rows: int
    tokens: int
    largest: int


def mix(items: DataFrame, item_id: str, source: str, size: str, targets: DataFrame, budget: int | None = None, seed: int = 0, rows_per_range: int = 100_000) -> Mixture:
    """Documents of several sources in target proportions, up to ``budget`` tokens.

    ``targets`` has ``source, target_share, max_repeats``. The default budget is
    the size of all items. ``documents`` has ``item_id, source, copy`` (0 for the
    first use), ``size, virtual_finish`` and is range-sorted by the last.
    ``shares`` has, for each source of ``targets``: ``source, target_share,
    actual_share, tokens, documents, uses, most_uses, exhausted``.

    Whole documents are taken while the total stays within the budget; documents
    of equal virtual finish are taken together or not at all.

    Defined cases: items of sources without a target, of a null source, or of
    null size aren't used (their sizes count for the default budget); a target
    share of null or not above 0 takes nothing; ``max_repeats`` null or below 1
    takes nothing; shares needn't add up to 1; items of size 0 are taken with
    their neighbours; repeated rows are items of their own; a source named twice
    in ``targets`` is an error; an empty table gives an empty mixture and shares
    of 0; other columns, whatever their names, are ignored.
    """
    rows = items.select(F.col(item_id).alias("item_id"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size"))
    # Read several times, and sizes may be costly to get; the number tells rows of one id apart.
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    stats = rows.groupBy("source").agg(F.count("size").alias("rows"), F.sum("size").alias("tokens"), F.max("size").alias("largest"))
    wanted = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    wanted = wanted.filter(F.col("source").isNotNull())
    if wanted.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    known = wanted.join(stats, "source", "left").collect()  # at most MOST_SOURCES rows, as checked
    if len({r.source for r in known}) < len(known):
        raise ValueError("a source is named twice in targets")
    if budget is None:
        budget = rows.agg(F.sum("size")).first()[0] or 0
    queues = [
        _Source(r.source, r.target_share, r.max_repeats, r.rows, r.tokens or 0, r.largest or 0)
        for r in known
        if (r.target_share or 0) > 0 and (r.max_repeats or 0) >= 1 and (r.rows or 0) > 0
    ]
    taken = cut(_order(rows, queues, budget, seed, rows_per_range))
    end = _end(taken, budget)
    documents = taken.filter(F.col("virtual_finish") <= F.lit(end)) if end is not None else taken.limit(0)

    per_item = documents.groupBy("source", "row").agg(F.count(F.lit(1)).alias("uses"), F.sum("size").alias("size"))
    used = per_item.groupBy("source").agg(
        F.sum("size").alias("tokens"),
        F.count(F.lit(1)).alias("documents"),
        F.sum("uses").alias("uses"),
        F.max("uses").alias("most_uses"),
    )
    full = [(q.name, q.rows * q.repeats) for q in queues]
    limits = items.sparkSession.createDataFrame(full, "source string, most bigint")
    total = W.partitionBy()
    shares = wanted.join(used, "source", "left").join(limits, "source", "left").fillna(0, ["tokens", "documents", "uses", "most_uses"])
    shares = shares.select(
        "source",
        "target_share",
        F.when(F.sum("tokens").over(total) > 0, F.col("tokens") / F.sum("tokens").over(total)).otherwise(0.0).alias("actual_share"),
        "tokens",
        "documents",
        "uses",
        "most_uses",
        (F.col("uses") >= F.coalesce("most", F.lit(0))).alias("exhausted"),
    )
    return Mixture(documents.drop("row").repartitionByRange("virtual_finish", "source").sortWithinPartitions("virtual_finish", "source"), shares)


def _served(queues: list[_Source], amount: float) -> float:
    """The virtual time at which fluid service of the queues has used ``amount`` tokens (infinite if it never does)."""
    rest, clock, open_ = float(amount), 0.0, sorted(queues, key=lambda q: q.tokens * q.repeats / q.weight)
    while open_:
        rate = sum(q.weight for q in open_)
        until = open_[0].tokens * open_[0].repeats / open_[0].weight
        if rest <= rate * (until - clock):
            return clock + rest / rate
        rest -= rate * (until - clock)
        clock = until
        open_ = open_[1:]
    return math.inf


def _order(rows: DataFrame, queues: list[_Source], budget: int, seed: int, rows_per_range: int) -> DataFrame:
    """Every use that can lie within the budget, with its virtual finish."""
    spark = rows.sparkSession
    # Fluid service is ahead of whole documents by less than one document per source: this much more suffices.
    latest = _served(queues, budget + sum(q.largest for q in queues))
    plan = []
    for q in queues:
        passes = q.repeats if math.isinf(latest) or q.tokens == 0 else min(q.repeats, int(q.weight * latest // q.tokens) + 1)
        plan.append((q.name, q.weight, passes, max(1, math.ceil(q.rows / rows_per_range))))
    uses = rows.join(F.broadcast(spark.createDataFrame(plan, "source string, weight double, passes int, ranges int")), "source")
    uses = uses.filter(F.col("size").isNotNull()).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    # 32 bits of an MD5, so that a range is found without overflow and SQL can repeat the order; ties go on by id.
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("item_id").cast("string"), F.col("copy").cast("string")))
    uses = uses.withColumn("h", F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"))
    uses = uses.withColumn("part", F.shiftright(F.col("h") * F.col("ranges"), 32).cast("int"))

    per_part = uses.groupBy("source", "copy", "part").agg(F.sum("size").alias("of_part"))
    earlier = W.partitionBy("source").orderBy("copy", "part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select("source", "copy", "part", F.coalesce(F.sum("of_part").over(earlier), F.lit(0)).alias("before"))
    within = W.partitionBy("source", "copy", "part").orderBy("h", "item_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    placed = uses.withColumn("running", F.sum("size").over(within)).join(offsets, ["source", "copy", "part"])
    return placed.select("item_id", "source", "copy", "size", "row", ((F.col("before") + F.col("running")) / F.col("weight")).alias("virtual_finish"))


def _end(uses: DataFrame, budget: int) -> float | None:
    """The latest virtual finish up to which all uses together stay within ``budget``; null if none does."""
    low, high, rows = uses.agg(F.min("virtual_finish"), F.max("virtual_finish"), F.count(F.lit(1))).first()
    if not rows:
        return None
    before, best = 0, None
    while True:
        # Bins over [low, high]; BINS + 1 rows come to the driver, whatever the data.
        step = (high - low) / BINS
        scope = uses.filter(F.col("virtual_finish").between(low, high))
        place = F.least(F.floor((F.col("virtual_finish") - F.lit(low)) / F.lit(step)), F.lit(BINS - 1)) if step > 0 else (F.col("virtual_finish") > F.lit(low)).cast("int")
        bins = scope.groupBy(place.alias("bin")).agg(
            F.sum("size").alias("tokens"), F.min("virtual_finish").alias("low"), F.max("virtual_finish").alias("high")
        )
        crossing = None
        for row in sorted(bins.collect(), key=lambda r: r.bin):
            if before + row.tokens > budget:
                crossing = row
                break
            before, best = before + row.tokens, row.high
        if crossing is None or crossing.low == crossing.high:
            return best
        # The lowest and the highest value are never in one bin, so the range shrinks.
        low, high = crossing.low, crossing.high
