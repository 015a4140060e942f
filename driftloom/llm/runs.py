"""Runs of like consecutive events, collapsed by a state machine over sorted streams.

The machine walks range-partitioned, sorted events with one open run, whose
anchor is its first event; the next event joins it if it is of the same entity,
like the anchor, and near enough in time, else the run is emitted. See
:mod:`driftloom.operators.stretches` for how runs across partitions are found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.times import instant, micros
from driftloom.operators.stretches import stretches


@dataclass(frozen=True)
class RunSpec:
    """Column names and tolerances of :func:`collapse_runs`.

    ``like`` maps the event column to a normal form; events of equal normal form
    are alike (unknown is like unknown). The default normal form is the event
    itself. With ``near`` the normal form is a number, and an event is like the
    anchor if it differs from it by at most so much.
    """

    entity: str
    time: str
    event: str
    id: str
    gap_seconds: int = 900
    like: object = None
    near: float | None = None

    def __post_init__(self) -> None:
        if self.gap_seconds < 0:
            raise ValueError("gap_seconds must not be negative")
        if self.near is not None and not self.near >= 0:
            raise ValueError("near must not be negative")


def collapse_runs(events: DataFrame, spec: RunSpec) -> DataFrame:
    """One row per run of consecutive like events of an entity.

    Returns ``entity, event`` (its anchor's normal form), ``first_id, last_id, start,
    end, duration_s, n_events``. Events of an entity are ordered by time, normal
    form (null first), id; an event joins the run before it if it is like the
    run's anchor and at most ``gap_seconds`` (inclusive) after the run's last
    event.

    Defined cases: an event without a time has no place in the order and is in
    no run; a null entity is an entity of its own, null ids come first; with
    ``near``, null and NaN events are like each other only; repeated rows count
    as events each; a single event is a run of one; an empty table yields no
    row; other columns, whatever their names, are ignored.
    """
    event: Column = spec.like(F.col(spec.event)) if spec.like else F.col(spec.event)
    event = event.cast("double") if spec.near is not None else event
    rows = events.select(F.col(spec.entity).alias("entity"), micros(F.col(spec.time)).alias("at"), event.alias("event"), F.col(spec.id).alias("id"))
    found = stretches(rows.filter(F.col("at").isNotNull()), spec.gap_seconds * 1_000_000, True, False, spec.near)
    return found.select(
        "entity",
        "event",
        "first_id",
        "last_id",
        instant(F.col("from_at")).alias("start"),
        instant(F.col("to_at")).alias("end"),
        ((F.col("to_at") - F.col("from_at")) / F.lit(1e6)).alias("duration_s"),
        F.col("n").alias("n_events"),
    )
