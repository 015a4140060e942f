"""Sessions: stretches of activity of an entity separated by silence.

The lag between an event and the one before flags the gaps, and the cumulative
sum of the flags numbers the sessions. A plain window per entity would put all
events of a busy entity into one task, so this runs over a range-partitioned,
sorted stream (:mod:`driftloom.operators.stretches`): the events are shuffled
once, by ranges of equal size, and only sessions at the ranges' edges meet again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.times import instant, micros
from driftloom.operators.stretches import stretches


@dataclass(frozen=True)
class SessionSpec:
    """Column names and threshold of :func:`sessionize`."""

    entity: str
    time: str
    id: str
    peer: str | None = None
    gap_seconds: int = 1800

    def __post_init__(self) -> None:
        if self.gap_seconds < 0:
            raise ValueError("gap_seconds must not be negative")


def sessionize(events: DataFrame, spec: SessionSpec) -> DataFrame:
    """One row per session of each entity.

    Returns ``entity, session_no, start, end, duration_s, n_events, n_peers,
    first_id, last_id``. Events of an entity are ordered by time, then id; a
    session begins at its first event and wherever the time since the event
    before exceeds ``gap_seconds`` (a silence of exactly the gap doesn't split).

    Defined cases: events without a time have no place in the order and belong
    to no session; a null entity is an entity of its own; null ids come first;
    null peers aren't counted among the distinct peers (0 without a peer
    column); repeated rows count as events each; events of equal time and id are
    interchangeable; an empty table yields no row; other columns of ``events``,
    whatever their names, are ignored.
    """
    peer = [F.col(spec.peer).alias("peer")] if spec.peer else []
    rows = events.select(F.col(spec.entity).alias("entity"), micros(F.col(spec.time)).alias("at"), F.col(spec.id).alias("id"), *peer)
    found = stretches(rows.filter(F.col("at").isNotNull()), spec.gap_seconds * 1_000_000, False, bool(peer))
    return found.select(
        "entity",
        F.col("number").alias("session_no"),
        instant(F.col("from_at")).alias("start"),
        instant(F.col("to_at")).alias("end"),
        ((F.col("to_at") - F.col("from_at")) / F.lit(1e6)).alias("duration_s"),
        F.col("n").alias("n_events"),
        F.col("n_peers") if peer else F.lit(0).cast("bigint").alias("n_peers"),
        "first_id",
        "last_id",
    )
