"""Items into containers of fixed capacity, with a controlled mixture of sources.

Items are dealt to slots of bounded size by hash, so each slot holds about the
same mixture whatever the sources' sizes. Within a slot every source is a queue
and every container a window: when it opens, each source's deficit grows by its
target share of the capacity; the source with the largest deficit is served and
pays for the item. Where containers hold many items (see ``MANY``):

- the item served is the source's largest that its deficit covers, else its smallest;
- an item larger than its source's part of a container is due in a window of its
  own, spread evenly over the slot. It is charged as one or two such parts, and
  what it costs beyond that is taken from the source's quantum in all windows,
  so that one such item doesn't starve its source in the next ones;
- of the deficit carried from earlier windows a window pays back only a part;
- a window's last room goes to one, two or three items that fit exactly.

Where containers hold few items no window can have the target mixture; there the
source with the largest deficit is served by its largest item that fits, which
leaves least room unused. In both cases the best fit of all queues comes last,
and in the end items of equal size change places where that brings both windows
nearer to their targets. Where the first way takes more windows than the second
(which depends on the sizes), the second one's result is taken.

Deficits go on from window to window. They also go on from slot to slot without
running the slots one after another: a slot packs all its items, so what it adds
to each deficit is known from its totals beforehand, and a slot starts from the
prefix sums over the slots before it.
"""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.session import cut, tasks_for, width

PACKED = "container string, container_id bigint, item_id {id}, source {source}, piece int, n_pieces int, size bigint"


#: A container holds many items if its capacity is so many mean sizes.
MANY = 6
#: How many times as many windows the better mixture may take.
ROOM_FIRST = 1.001
#: Rows of a slot; as many slots as the session is wide are made of fewer, but not of fewer than the least.
MOST_ROWS, LEAST_ROWS = 100_000, 10_000


def pack(
    items: DataFrame, item_id: str, source: str, size: str, capacities: dict[str, int], rows_per_slot: int | None = None, targets: dict[str | None, float] | None = None
) -> DataFrame:
    """Every item in containers of each named capacity.

    Returns ``container`` (the capacity's name), ``container_id``, ``item_id,
    source, piece, n_pieces, size``. No container holds more than its capacity.
    An item is cut only if it is larger than the capacity: into full containers
    and at most one smaller piece. ``targets`` are the sources' shares (0 for
    sources not named); without them they are the shares of all tokens. As all
    items are packed, targets other than these hold only until a source is used up.

    How near a container comes to the target depends on how many items it holds:
    one that an item fills by half, or that takes two or three, can't have the
    target mixture. The README gives measured distances.

    Defined cases: a null source is a source of its own; null ids are kept;
    repeated rows are items of their own; items of size 0 are placed and take no
    room; rows with a null size are not items; an empty table yields no row;
    other columns, whatever their names, are ignored.
    """
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be positive")
    if targets is not None and (not targets or min(targets.values()) < 0 or sum(targets.values()) <= 0):
        raise ValueError("target shares must not be negative, and not all be 0")
    rows = items.select(F.col(item_id).alias("item_id"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size"))
    # Written once: the sizes may be costly to get, and a row's number must stay the same if a task runs again.
    rows = cut(rows.filter(F.col("size").isNotNull()).withColumn("row", F.monotonically_increasing_id()))
    count = rows.count()
    spark = items.sparkSession
    slots = tasks_for(spark, count, rows_per_slot or MOST_ROWS)
    if rows_per_slot is None:
        slots = max(slots, min(width(spark), tasks_for(spark, count, LEAST_ROWS)))
    # Dealt by row, not by id: any number of rows may share an id.
    rows = rows.select("item_id", "source", "size", "row", F.pmod(F.xxhash64("row"), F.lit(slots)).cast("int").alias("slot"))

    # One row per slot and source that meet in it; everything below is computed from these few.
    totals = cut(rows.groupBy("slot", "source").agg(F.sum("size").alias("tokens")))
    whole = totals.agg(F.sum("tokens")).first()[0] or 1
    of_source = W.partitionBy("source").orderBy("slot")
    earlier = W.unboundedPreceding, -1
    slots_before = totals.groupBy("slot").agg(F.sum("tokens").alias("all"))
    slots_before = slots_before.select(F.col("slot").alias("of_slot"), F.coalesce(F.sum("all").over(W.orderBy("slot").rowsBetween(*earlier)), F.lit(0)).alias("all_before"))
    carry = totals.select(
        F.col("slot").alias("of_slot"),
        F.col("source").alias("queue"),
        (F.sum("tokens").over(of_source.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) / F.lit(float(whole))).alias("share"),
        F.coalesce(F.sum("tokens").over(of_source.rowsBetween(*earlier)), F.lit(0)).alias("before"),
    ).join(slots_before, "of_slot")
    if targets is not None:
        of_all = float(sum(targets.values()))
        named_ones = spark.createDataFrame([(k, v / of_all) for k, v in targets.items()], f"named {dict(rows.dtypes)['source']}, target double")
        carry = carry.join(named_ones, F.col("queue").eqNullSafe(F.col("named")), "left").withColumn("share", F.coalesce("target", F.lit(0.0)))
    carry = carry.select("of_slot", "queue", "share", (F.col("share") * F.col("all_before") - F.col("before")).alias("deficit"))

    named = dict(sorted(capacities.items()))
    kinds = dict(rows.dtypes)
    schema = PACKED.format(id=kinds["item_id"], source=kinds["source"])

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        shares = {s: (w, d) for s, w, d in zip(*(right.column(c).to_pylist() for c in ("queue", "share", "deficit")))}
        left = left.sort_by("row")  # the same however the rows come
        sources, sizes = (left.column(c).to_pylist() for c in ("source", "size"))
        slot = left.column("slot")[0].as_py() if left.num_rows else 0
        out: list[tuple] = []
        for name, capacity in named.items():
            for k, row, piece, pieces, tokens in fill_slot(sources, sizes, capacity, shares, slot):
                out.append((name, (slot << 32) + k, row, piece, pieces, tokens))
        take = pa.array([x[2] for x in out], pa.int64())
        return pa.table(
            {
                "container": pa.array([x[0] for x in out], pa.string()),
                "container_id": pa.array([x[1] for x in out], pa.int64()),
                "item_id": left.column("item_id").take(take),
                "source": left.column("source").take(take),
                "piece": pa.array([x[3] for x in out], pa.int32()),
                "n_pieces": pa.array([x[4] for x in out], pa.int32()),
                "size": pa.array([x[5] for x in out], pa.int64()),
            }
        )

    # Packing is work per item, not per byte: each slot keeps a task of its own, so small ones aren't merged into one.
    left = rows.repartitionById(slots, F.col("slot")).groupBy("slot")
    return left.cogroup(carry.repartitionById(slots, F.col("of_slot")).groupBy("of_slot")).applyInArrow(fill, schema)


def fill_slot(sources: list, sizes: list[int], capacity: int, shares: dict, seed: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Pack one slot; returns (window, row, piece, pieces, size) for every piece.

    ``shares`` maps each source to its target share and the deficit it starts with.
    """
    if not sizes:
        return []
    slot = _Slot(sources, sizes, capacity, shares, random.Random(seed))
    slot.fill_largest_first()
    if capacity * len(sizes) >= MANY * sum(sizes):
        even = _Slot(sources, sizes, capacity, shares, random.Random(seed))
        even.fill_evenly()
        # Room comes first: sizes may be such that only large ones first leave little unused.
        if even.window <= slot.window * ROOM_FIRST:
            slot = even
    return exchange_equals(slot.out, sources, capacity, {s: share for s, (share, _) in shares.items()})


class _Slot:
    """A slot being packed."""

    def __init__(self, sources: list, sizes: list[int], capacity: int, shares: dict, rng: random.Random) -> None:
        self.capacity, self.rng = capacity, rng
        self.fair = {s: w * capacity for s, (w, _) in shares.items()}
        self.carry = {s: float(d) for s, (_, d) in shares.items()}
        self.deficit = dict(self.carry)
        #: By source and size, the pieces (row, piece, pieces) in stock; and a bit per size in stock.
        self.stock: dict[object, dict[int, list[tuple[int, int, int]]]] = {}
        self.bits: dict[object, int] = {}
        self.out: list[tuple[int, int, int, int, int]] = []
        self.window, self.room = 0, capacity
        self.left = sum(sizes)
        for row, (s, size) in enumerate(zip(sources, sizes)):
            full, rest = divmod(size, capacity) if size > capacity else (0, size)
            pieces = full + (rest > 0 or not full)
            # Each full piece waits for its turn like any other item.
            for piece in range(full):
                self.add(s, capacity, (row, piece, pieces))
            if pieces > full:
                self.add(s, rest, (row, full, pieces))

    def add(self, s: object, size: int, piece: tuple[int, int, int]) -> None:
        self.stock.setdefault(s, {}).setdefault(size, []).append(piece)
        self.bits[s] = self.bits.get(s, 0) | 1 << size

    def take(self, s: object, size: int) -> tuple[int, int, int]:
        queue = self.stock[s][size]
        piece = queue.pop()
        if not queue:
            del self.stock[s][size]
            self.bits[s] ^= 1 << size
            if not self.bits[s]:
                del self.bits[s]
        return piece

    def place(self, s: object, size: int, piece: tuple[int, int, int], charged: float | None = None) -> None:
        self.out.append((self.window, *piece, size))
        self.deficit[s] -= size
        self.carry[s] -= size if charged is None else charged
        self.room -= size
        self.left -= size

    def fitting(self) -> list:
        """The sources with an item that fits."""
        within = (1 << (self.room + 1)) - 1
        return [s for s, b in self.bits.items() if b & within]

    def largest(self, s: object, most: int) -> int:
        """The source's largest size of at most so much; -1 if there is none."""
        return (self.bits.get(s, 0) & ((1 << (most + 1)) - 1)).bit_length() - 1

    def best_fit(self, closing: bool = False) -> None:
        """Fill the window with the most indebted source's largest item that fits; the last one is the best fit of all."""
        while live := self.fitting():
            if closing and self.room <= CLOSED * self.capacity and self._close(live):
                continue
            s = max(live, key=self.deficit.__getitem__)
            size = self.largest(s, self.room)
            rest = (1 << (self.room - size + 1)) - 1
            if size < self.room and not any(b & rest for b in self.bits.values()):
                size, s = max(((self.largest(x, self.room), x) for x in live), key=lambda o: o[0])
            self.place(s, size, self.take(s, size))

    def fill_largest_first(self) -> None:
        while self.bits:
            self.room = self.capacity
            for s, quantum in self.fair.items():
                self.deficit[s] += quantum
            self.best_fit()
            self.window += 1

    def fill_evenly(self) -> None:
        capacity, total = self.capacity, self.left
        windows = -(-total // capacity)
        due, quantum = self._schedule(windows)
        waiting: list = []
        while self.bits or due or waiting:
            self.room = capacity
            # A window pays back a part of what is carried.
            for s, fair in self.fair.items():
                self.deficit[s] = quantum[s] + max(-PAID_BACK * fair, min(self.carry[s], PAID_BACK * fair + LAST * capacity / 2))
                self.carry[s] += quantum[s]
            late = self.left < max(LAST * total, LAST_WINDOWS * capacity)
            while due and (late or due[-1][0] <= self.window):
                at, turn, s, size, piece = due.pop()
                heapq.heappush(waiting, (-size, at, turn, id(piece), s, piece))
            if late:
                for size, *_, s, piece in waiting:
                    self.add(s, -size, piece)
                waiting = []
                self.best_fit(closing=True)
            else:
                waiting = self._place_due(waiting)
                self._serve()
            self.window += 1

    def _schedule(self, windows: int) -> tuple[list, dict]:
        """Items larger than their source's part of a container with the windows they are due in, the first last; the sources' quanta."""
        due, quantum = [], {}
        for turn, s in enumerate(self.fair):
            fair, stock = self.fair[s], self.stock.get(s, {})
            large = [(size, piece) for size, queue in stock.items() if size > fair for piece in queue]
            whole = sum(size * len(queue) for size, queue in stock.items())
            beyond = sum(max(size - CHARGED * fair, 0.0) for size, _ in large)
            quantum[s] = fair * (1.0 - beyond / whole) if whole else 0.0
            self.rng.shuffle(large)
            start = self.rng.random()
            for i, (size, piece) in enumerate(large):
                self.take_out(s, size, piece)
                due.append(((i + start) * windows * (1.0 - LAST) / len(large), turn, s, size, piece))
        due.sort(key=lambda d: (d[0], d[1]), reverse=True)
        return due, quantum

    def take_out(self, s: object, size: int, piece: tuple[int, int, int]) -> None:
        self.stock[s].pop(size, None)
        if s in self.bits and self.bits[s] >> size & 1:
            self.bits[s] ^= 1 << size
            if not self.bits[s]:
                del self.bits[s]

    def _place_due(self, waiting: list) -> list:
        """Place what is due and fits, but only one really large item; the others go on waiting."""
        kept = []
        while waiting:
            entry = heapq.heappop(waiting)
            size, s, piece = -entry[0], entry[4], entry[5]
            if size <= self.room and (size < LARGE * self.capacity or self.room == self.capacity):
                self.place(s, size, piece, min(size, CHARGED * self.fair[s]))
            else:
                kept.append(entry)
        heapq.heapify(kept)
        return kept

    def _serve(self) -> None:
        """Fill the window by deficit, its last room exactly if that can be done."""
        while live := self.fitting():
            if self.room <= CLOSED * self.capacity:
                if not self._close(live):
                    s = max(live, key=lambda x: (self.largest(x, self.room), self.deficit[x]))
                    size = self.largest(s, self.room)
                    self.place(s, size, self.take(s, size))
                continue
            s = max(live, key=self.deficit.__getitem__)
            size = self.largest(s, int(max(min(self.deficit[s], self.room), 0)))
            if size < 0:
                size = (self.bits[s] & -self.bits[s]).bit_length() - 1
            self.place(s, size, self.take(s, size))

    def _close(self, live: list) -> bool:
        """Use up the room with one, two or three items, from indebted sources if there is a choice."""
        if not self.room:
            return False
        exact = [s for s in live if self.bits[s] >> self.room & 1]
        if exact:
            s = max(exact, key=self.deficit.__getitem__)
            size = self.room
            self.place(s, size, self.take(s, size))
            return True
        sizes = 0
        for b in self.bits.values():
            sizes |= b
        order = sorted(live, key=self.deficit.__getitem__, reverse=True)
        for n_more in (1, 2):
            for s in order:
                for size in sorted((n for n in self.stock[s] if 0 < n < self.room), reverse=True):
                    more = self._exactly(self.room - size, n_more, sizes, s, size)
                    if more:
                        self.place(s, size, self.take(s, size))
                        for x, n in more:
                            self.place(x, n, self.take(x, n))
                        return True
        return False

    def _exactly(self, room: int, n_more: int, sizes: int, s: object, size: int) -> list | None:
        """One or two items of exactly so much together, besides one of ``size`` of the source ``s``; null if there are none."""
        if n_more == 1:
            if not sizes >> room & 1:
                return None
            rest = [x for x, b in self.bits.items() if b >> room & 1 and (x != s or room != size or len(self.stock[s][size]) > 1)]
            return [(max(rest, key=self.deficit.__getitem__), room)] if rest else None
        # Two sizes that add up to the room: those of which the mirror image is a size too. None is the first's, so that none is counted twice.
        within = sizes & ((1 << room) - 2) & ~(1 << size)
        pairs = within & int(format(within, f"0{room + 1}b")[::-1], 2) & ~(1 << room // 2 if room % 2 == 0 else 0)
        if not pairs:
            return None
        other = pairs.bit_length() - 1
        return [(max((x for x, b in self.bits.items() if b >> n & 1), key=self.deficit.__getitem__), n) for n in (other, room - other)]


#: The last part of a slot (and at least so many windows), and of a window, that is filled for least unused room.
LAST, LAST_WINDOWS, CLOSED = 0.05, 6, 0.2
#: How much of a source's part of a window is paid back of what is carried; how many parts a larger item is charged at most.
PAID_BACK, CHARGED = 0.5, 2.0
#: An item of this part of the capacity is alone of its kind in a window.
LARGE = 0.25
#: Items of equal size are exchanged between so many sources, those of the largest shares.
EXCHANGED = 32


def exchange_equals(out: list, sources: list, capacity: int, shares: dict, rounds: int = 10) -> list:
    """The same windows, items of equal size exchanged where both windows come nearer to the target shares."""
    chosen = sorted(shares, key=lambda s: (-shares[s], str(s)))[:EXCHANGED]
    number = {s: i for i, s in enumerate(chosen)}
    place = [o[0] for o in out]
    held = [0] * (max(place) + 1)
    for window, *_, size in out:
        held[window] += size
    over = [[-shares[s] * h for s in chosen] for h in held]
    alike: dict[int, list[int]] = defaultdict(list)
    for i, (window, row, _, _, size) in enumerate(out):
        if sources[row] in number:
            over[window][number[sources[row]]] += size
            if 0 < size < capacity:
                alike[size].append(i)
    for _ in range(rounds):
        moved = False
        for size, those in alike.items():
            mine: dict[int, list[int]] = defaultdict(list)
            for i in those:
                k = number[sources[out[i][1]]]
                if over[place[i]][k] > 0:
                    mine[k].append(i)
            for a in mine:
                for b in mine:
                    if a >= b:
                        continue
                    # Those come first whose windows have most of the one and least of the other.
                    first = sorted(mine[a], key=lambda i: over[place[i]][b] - over[place[i]][a])
                    second = sorted(mine[b], key=lambda i: over[place[i]][a] - over[place[i]][b])
                    for i, j in zip(first, second):
                        x, y = over[place[i]], over[place[j]]
                        now = abs(x[a]) + abs(x[b]) + abs(y[a]) + abs(y[b])
                        if x is not y and now > abs(x[a] - size) + abs(x[b] + size) + abs(y[a] + size) + abs(y[b] - size) + 1e-6:
                            x[a], x[b], y[a], y[b] = x[a] - size, x[b] + size, y[a] + size, y[b] - size
                            place[i], place[j] = place[j], place[i]
                            # The lists are by source: the items themselves stay in them.
                            moved = True
        if not moved:
            break
    return [(window, *o[1:]) for window, o in zip(place, out)]
