"""Stretches of consecutive events, cut by a state machine over sorted streams.

Events are range-partitioned by (entity, time, .., id) and sorted within the
partitions, so partitions are of equal size whatever the entities' sizes: a busy
entity simply spans many of them, and rows that are copies of each other are
dealt to turns. In each partition a state machine walks the stream with one open
stretch: the next event joins it if it is of the same entity, near enough in
time and (if asked) of the same kind, else the stretch is emitted.

Only a partition's first and last stretch can be part of a longer one. The
stretches are written once, those apart from all others; these few (at most two
per partition) then meet by entity, and nothing else is moved again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.session import cut, written

#: Copies of a row are dealt to so many turns, by blocks of rows, between which the stream may be cut.
TURNS = 256
#: What a written row is: a stretch within a partition, one at its edge, a peer of one at an edge, one of the partition's first entity.
INNER, EDGE, PEER_OF_EDGE, HEAD = range(4)


def stretches(events: DataFrame, gap: int, by_event: bool, with_peers: bool, near: float | None = None) -> DataFrame:
    """One row per stretch of ``events`` (``entity, at`` in microseconds, ``id``, and ``event`` or ``peer`` if asked for).

    Events of an entity are ordered by at, event, id (null first each). A
    stretch ends where the time to the next event exceeds ``gap`` or the event
    changes or, with ``near``, is a number further than that from the stretch's
    first (null and NaN are near each other only). Returns ``entity, [event,]
    number`` (from 1 within the entity; the event is the first one's),
    ``first_id, last_id, from_at, to_at, n`` and, with peers, ``n_peers``: its
    distinct non-null peers.

    A row without ``at`` must not be among them. A null entity is an entity.

    With ``near`` where a stretch ends depends on where it began, maybe in an
    earlier partition. The walk is then repeated with the state that each
    partition is left in handed to the next, until these states (a row per
    partition) stand still; a walk forgets its first state at the first gap or
    jump, so that two rounds are usual.
    """
    if near is not None and not by_event:
        raise ValueError("near needs events")
    columns = ["entity", "at", *(["event"] if by_event else []), "id"]
    order = [*columns, "turn"]
    rows = events.select(*columns, *(["peer"] if with_peers else []), F.pmod(F.shiftright(F.monotonically_increasing_id(), 10), F.lit(TURNS)).cast("smallint").alias("turn"))
    stream = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn")
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    schema = T.StructType(
        [T.StructField("entity", kinds["entity"])]
        + ([T.StructField("event", kinds["event"])] if by_event else [])
        + [T.StructField(c, kinds["id"]) for c in ("first_id", "last_id")]
        + [T.StructField(c, T.LongType()) for c in ("from_at", "to_at", "n", "n_peers", "place", "number")]
        + [T.StructField("goes_on", T.BooleanType()), T.StructField("is_last", T.BooleanType()), T.StructField("peer", kinds.get("peer", T.NullType()) if with_peers else T.StringType())]
        + [T.StructField("kind", T.IntegerType())]
    )

    arriving: dict[int, tuple] = {}
    if near is not None:
        stream = cut(stream)  # the same partitions in the same order in every round
        arriving = _arriving(stream, gap, near)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        machine = _Machine(gap, by_event, with_peers, part << 33, near, arriving.get(part))
        for batch in batches:
            if batch.num_rows:
                yield from machine.take(pa.Table.from_batches([batch]))
        yield from machine.end()

    made = written(stream.mapInArrow(walk, schema), by="kind")
    kept = ["entity", *(["event"] if by_event else []), "number", "first_id", "last_id", "from_at", "to_at", "n", *(["n_peers"] if with_peers else [])]

    lane = W.partitionBy("entity").orderBy("place")
    edges = made.filter(F.col("kind") == EDGE).withColumn("part", F.shiftright("place", 33))
    before = {c: F.lag(c).over(lane) for c in ("part", "to_at", "event") if c in edges.columns}
    goes_on = before["part"].isNotNull() & (before["part"] < F.col("part")) & (F.col("from_at") - before["to_at"] <= gap)
    if near is not None:
        goes_on = F.col("goes_on")
    elif by_event:
        goes_on = goes_on & before["event"].eqNullSafe(F.col("event"))
    edges = edges.withColumn("opens", (~goes_on).cast("int"))
    upto = lane.rowsBetween(W.unboundedPreceding, 0)
    # The entity's stretches in the partitions before, less those that go on in the next one.
    carried = F.coalesce(F.sum(F.when(F.col("is_last"), F.col("number"))).over(lane.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = edges.withColumns(
        {
            "whole": F.sum("opens").over(upto),
            "closes": F.coalesce(F.lead("opens").over(lane) == 1, F.lit(True)),
            "number": F.col("number") + carried - F.sum(1 - F.col("opens")).over(upto),
        }
    )
    joined = edges.groupBy("entity", "whole").agg(
        *([F.max(F.when(F.col("opens") == 1, F.col("event"))).alias("event")] if by_event else []),
        F.min("number").alias("number"),
        F.max(F.when(F.col("opens") == 1, F.col("first_id"))).alias("first_id"),
        F.max(F.when(F.col("closes"), F.col("last_id"))).alias("last_id"),
        F.min("from_at").alias("from_at"),
        F.max("to_at").alias("to_at"),
        F.sum("n").alias("n"),
    )
    # One or two rows per partition, whatever the data: these may be broadcast.
    if with_peers:
        whose = edges.select("place", "whole")
        peers = made.filter(F.col("kind") == PEER_OF_EDGE).select("entity", "place", "peer").join(F.broadcast(whose), "place")
        distinct = peers.groupBy("entity", "whole").agg(F.countDistinct("peer").alias("n_peers"))
        joined = joined.alias("j").join(distinct.alias("d"), F.expr("j.entity <=> d.entity and j.whole = d.whole"), "left")
        joined = joined.select(*[F.col(f"j.{c}") for c in kept if c != "n_peers"], F.coalesce("d.n_peers", F.lit(0)).alias("n_peers"))
    first = edges.filter(F.col("place") == F.shiftleft("part", 33)).select("part", (F.col("number") - 1).alias("earlier"))
    head = made.filter(F.col("kind") == HEAD).withColumn("part", F.shiftright("place", 33)).join(F.broadcast(first), "part")
    head = head.withColumn("number", F.col("number") + F.col("earlier"))
    inner = made.filter(F.col("kind") == INNER)
    return inner.select(*kept).unionByName(head.select(*kept)).unionByName(joined.select(*kept))


def _arriving(stream: DataFrame, gap: int, near: float) -> dict[int, tuple]:
    """For each partition the entity, time and anchor that the ones before leave behind."""
    rows: list = []
    while True:
        left: dict[int, tuple] = {r.part: (r.entity, r.at, r.anchor) for r in rows}
        parts = sorted(left)
        arriving = {b: left[a] for a, b in zip(parts, parts[1:])}
        kind = dict(stream.dtypes)["entity"]

        def walk(batches: Iterator[pa.RecordBatch], arriving: dict = arriving) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            machine = _Machine(gap, True, False, part << 33, near, arriving.get(part))
            for batch in batches:
                if batch.num_rows:
                    for _ in machine.take(pa.Table.from_batches([batch])):
                        pass
            if machine.opened is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part]), machine.latest.column("entity").combine_chunks(), machine.latest.column("at").combine_chunks(), pa.array([machine.anchor], pa.float64())],
                    names=["part", "entity", "at", "anchor"],
                )

        # A row per partition comes to the driver.
        found = stream.mapInArrow(walk, f"part bigint, entity {kind}, at bigint, anchor double").collect()
        if {r.part: (r.entity, r.at, r.anchor) for r in found} == left:
            return arriving
        rows = found


@dataclass
class _Machine:
    """The walk through one partition: the open stretch, and what has been emitted."""

    gap: int
    by_event: bool
    with_peers: bool
    part: int
    near: float | None = None
    #: Entity, time and anchor left by the partitions before.
    arriving: tuple | None = None
    emitted: int = 0
    #: The open stretch: its first and latest event, their number, its peers, its number within the entity, whether the entity is the partition's first.
    opened: pa.Table | None = None
    latest: pa.Table | None = None
    count: int = 0
    peers: set = field(default_factory=set)
    number: int = 1
    head: bool = True
    #: The number that the open stretch's events are compared with, and whether the first stretch goes on from an earlier partition.
    anchor: float | None = None
    goes_on: bool = False

    def take(self, now: pa.Table) -> Iterator[pa.RecordBatch]:
        """The stretches that end with these events."""
        opens, changes = self._breaks(now)
        starts = np.flatnonzero(opens)
        tally, of_first, of_last = self._peers(now, opens, len(starts))
        if not len(starts):
            self.count, self.latest = self.count + now.num_rows, now.slice(now.num_rows - 1)
            self.peers |= of_first
            return
        # Numbers within the entity, and whether it is still the partition's first.
        place = np.arange(len(starts))
        fresh = np.maximum.accumulate(np.where(changes[starts], place, -1))
        has_open = self.opened is not None
        numbers = np.where(fresh >= 0, place - fresh + 1, place + 1 + (self.number if has_open else 0))
        heads = (fresh < 0) & self.head
        stops = np.append(starts[1:], now.num_rows)
        first, last, n = now.take(starts[:-1]), now.take(stops[:-1] - 1), (stops - starts)[:-1]
        if has_open:
            end = now.slice(starts[0] - 1, 1) if starts[0] else self.latest
            first, last = pa.concat_tables([self.opened, first]), pa.concat_tables([end, last])
            n = np.append(self.count + starts[0], n)
            all_numbers, all_heads = np.append(self.number, numbers[:-1]), np.append(self.head, heads[:-1])
            self.peers |= of_first
            tally = np.append(len(self.peers), tally[1:-1])
        else:
            all_numbers, all_heads, tally = numbers[:-1], heads[:-1], tally[1:-1]
        if len(n):
            # The partition's first stretch is its first event's; its peers are known by name.
            names = (self.peers if has_open else self._named(now.slice(starts[0], n[0]))) if not self.emitted else set()
            yield from self._emit(first, last, n, tally, all_numbers, all_heads, names, False)
        self.opened, self.latest = now.slice(starts[-1], 1), now.slice(now.num_rows - 1)
        self.count, self.peers, self.number, self.head = int(now.num_rows - starts[-1]), of_last, int(numbers[-1]), bool(heads[-1])

    def end(self) -> Iterator[pa.RecordBatch]:
        """The partition's last stretch."""
        if self.opened is not None:
            one = np.array([self.count]), np.array([len(self.peers)]), np.array([self.number]), np.array([self.head])
            yield from self._emit(self.opened, self.latest, *one, self.peers, True)

    def _breaks(self, now: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Whether each event opens a stretch, and whether it is of another entity than the one before."""
        joined = pa.concat_tables([self.latest, now]) if self.latest is not None else now
        m = joined.num_rows
        opens, changes = np.ones(m, dtype=bool), np.zeros(m, dtype=bool)
        if m > 1:
            at = joined.column("at").to_numpy()
            opens[1:] = np.diff(at) > self.gap
            for name in ("entity", "event") if self.by_event and self.near is None else ("entity",):
                column = joined.column(name).combine_chunks()
                a, b = column.slice(0, m - 1), column.slice(1)
                differs = pc.fill_null(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
                opens[1:] |= differs
                if name == "entity":
                    changes[1:] = differs
        skip = self.latest is not None
        opens, changes = opens[skip:], changes[skip:]
        return (self._anchored(now, opens) if self.near is not None else opens), changes

    def _anchored(self, now: pa.Table, opens: np.ndarray) -> np.ndarray:
        """The same, further apart where an event isn't near its stretch's first."""
        values = [None if x is None or x != x else x for x in now.column("event").cast(pa.float64()).to_pylist()]
        if self.latest is None and self.arriving is not None:
            # The partition's first event may go on with a stretch of an earlier one.
            entity, at, anchor = self.arriving
            same = now.column("entity")[0].as_py() == entity and now.column("at")[0].as_py() - at <= self.gap
            self.goes_on = same and (values[0] == anchor if values[0] is None or anchor is None else abs(values[0] - anchor) <= self.near)
            self.anchor = anchor if self.goes_on else values[0]
            first = 1
        else:
            first = 0
        out, near, anchor = opens.tolist(), self.near, self.anchor
        for i in range(first, len(values)):
            x = values[i]
            if out[i] or (x is not anchor if x is None or anchor is None else abs(x - anchor) > near):
                out[i], anchor = True, x
        self.anchor = anchor
        return np.array(out, dtype=bool)

    def _named(self, rows: pa.Table) -> set:
        return set(pc.unique(rows.column("peer")).to_pylist()) - {None} if self.with_peers else set()

    def _peers(self, now: pa.Table, opens: np.ndarray, n: int) -> tuple[np.ndarray, set, set]:
        """Distinct peers of the open stretch's events and of each new stretch; the first's and the last's by name."""
        tally = np.zeros(n + 1, dtype=np.int64)
        if not self.with_peers:
            return tally, set(), set()
        coded = pc.dictionary_encode(now.column("peer").combine_chunks())
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        wide = len(coded.dictionary) + 1
        pairs = np.unique((np.cumsum(opens) * wide + codes)[codes >= 0])
        owner = pairs // wide
        np.add.at(tally, owner, 1)
        by_name = lambda k: set(coded.dictionary.take(pa.array(pairs[owner == k] % wide)).to_pylist())
        return tally, by_name(0), by_name(n) if n else set()

    def _emit(
        self, first: pa.Table, last: pa.Table, n: np.ndarray, tally: np.ndarray, numbers: np.ndarray, heads: np.ndarray, names: set, is_last: bool
    ) -> Iterator[pa.RecordBatch]:
        m = len(n)
        kind = np.where(heads, HEAD, INNER)
        if is_last:
            kind[-1] = EDGE
        if not self.emitted:
            kind[0] = EDGE
        places = self.part + self.emitted + np.arange(m)
        ends, goes_on = np.zeros(m, dtype=bool), np.zeros(m, dtype=bool)
        ends[-1] = is_last
        goes_on[0] = self.goes_on and not self.emitted
        self.emitted += m
        peer_type = first.schema.field("peer").type if self.with_peers else pa.string()
        columns = {"entity": first.column("entity")}
        if self.by_event:
            columns["event"] = first.column("event")
        columns |= {
            "first_id": first.column("id"), "last_id": last.column("id"), "from_at": first.column("at"), "to_at": last.column("at"), "n": pa.array(n.astype(np.int64)),
            "n_peers": pa.array(tally.astype(np.int64)), "place": pa.array(places), "number": pa.array(numbers.astype(np.int64)), "goes_on": pa.array(goes_on), "is_last": pa.array(ends),
            "peer": pa.nulls(m, peer_type), "kind": pa.array(kind.astype(np.int32)),
        }
        made = pa.table(columns)
        yield from made.combine_chunks().to_batches()
        if names:
            k = 0 if kind[0] == EDGE else m - 1
            rows = pa.array(np.full(len(names), k))
            # Of such a row only the entity, the place and the peer have a meaning.
            of = made.take(rows)
            of = of.set_column(of.schema.get_field_index("peer"), "peer", pa.array(list(names), peer_type))
            of = of.set_column(of.schema.get_field_index("kind"), "kind", pa.array(np.full(len(names), PEER_OF_EDGE, np.int32)))
            yield from of.combine_chunks().to_batches()
