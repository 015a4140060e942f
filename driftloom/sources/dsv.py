"""Raw delimited lines into typed rows, or into reasons why they aren't.

The tokenizer is a finite-state machine over bytes. A batch of lines is one
byte buffer, cut into blocks of equal length whatever the lines' lengths:

1. every block's transition function (end state for each start state) is
   computed for all blocks at once, byte position by byte position;
2. the functions are composed in a parallel prefix scan, which gives the state
   each block starts in;
3. all blocks run once more from their known states; separators, field contents
   and errors are read off the states.

So a very long line costs as much per byte as short ones, and no step loops
over lines. Typing happens afterwards in Spark expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.sources.tables import PEER, USER

# Byte classes.
OTHER, COMMA, QUOTE, BLANK, END = range(5)
# States: before a field, in a bare field, in quotes, after a quote in quotes,
# after the closing quote, and two sticky errors.
START, BARE, QUOTED, CLOSING, CLOSED, STRAY_QUOTE, TRAILING = range(7)
N_STATES = 7

#: TRANSITIONS[class][state]: the next state.
TRANSITIONS = np.array(
    [
        [BARE, BARE, QUOTED, TRAILING, TRAILING, STRAY_QUOTE, TRAILING],
        [START, START, QUOTED, START, START, STRAY_QUOTE, TRAILING],
        [QUOTED, STRAY_QUOTE, CLOSING, QUOTED, TRAILING, STRAY_QUOTE, TRAILING],
        [START, BARE, QUOTED, CLOSED, CLOSED, STRAY_QUOTE, TRAILING],
        [START, START, START, START, START, START, START],
    ],
    dtype=np.uint8,
)
BLOCK = 64


def states_before(classes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The machine's state before each byte, from the byte classes of a whole buffer."""
    n = len(classes)
    if n == 0:
        return np.zeros(0, dtype=np.uint8)
    blocks = -(-n // block)
    padded = np.full(blocks * block, OTHER, dtype=np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(blocks, block).T)
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (blocks, 1))
    for step in steps:
        maps = TRANSITIONS[step[:, None], maps]
    reach = 1
    while reach < blocks:
        maps = np.concatenate([maps[:reach], np.take_along_axis(maps[reach:], maps[:-reach], axis=1)])
        reach *= 2
    state = np.concatenate([[np.uint8(START)], maps[:-1, START]])
    before = np.empty((block, blocks), dtype=np.uint8)
    for j, step in enumerate(steps):
        before[j] = state
        state = TRANSITIONS[step, state]
    return before.T.ravel()[:n]


def tokenize(lines: pa.Array, width: int, block: int = BLOCK) -> dict[str, pa.Array]:
    """Fields of each line.

    Returns ``f0..f{width-1}`` (null unless the line is sound and has ``width``
    fields), ``at0..at{width-1}`` (the byte offsets where they begin),
    ``n_fields``, ``problem`` (null or a reason) and ``offset`` (byte
    offset of the problem in its line, null if there is none).
    """
    count = len(lines)
    void = np.asarray(lines.is_null())
    lines = lines.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + count + 1]
    data = lines.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]
    # Each line is followed by one END byte, which takes the place of a carriage return ending it.
    starts = bounds[:-1] + np.arange(count)
    ends = bounds[1:] + np.arange(count)
    body = np.ones(len(raw) + count, dtype=bool)
    body[ends] = False
    buffer = np.full(len(raw) + count, 10, dtype=np.uint8)
    buffer[body] = raw
    lookup = np.full(256, OTHER, dtype=np.uint8)
    lookup[[ord(","), ord('"'), ord(" "), ord("\t")]] = [COMMA, QUOTE, BLANK, BLANK]
    classes = lookup[buffer]
    classes[ends] = END
    last = np.maximum(ends - 1, 0)
    returns = (ends > starts) & (buffer[last] == 13)
    # An END leads to the start state from anywhere, so a second END after it is harmless.
    stop = ends - returns
    classes[stop] = END
    before = states_before(classes, block)

    row = np.repeat(np.arange(count), ends - starts + 1)
    splits = (classes == COMMA) & (before != QUOTED) & (before < STRAY_QUOTE)
    n_fields = 1 + np.bincount(row[splits], minlength=count)
    closing = before[stop]
    problem = np.full(count, None, dtype=object)
    offset = np.full(count, -1, dtype=np.int64)

    odd = n_fields != width
    problem[odd] = "column count"
    offset[odd] = (stop - starts)[odd]
    surplus = np.flatnonzero(splits)
    rank = np.arange(len(surplus)) - np.concatenate([[0], np.cumsum(n_fields - 1)])[row[surplus]]
    extra = surplus[rank == width - 1]
    offset[row[extra]] = extra - starts[row[extra]]

    opens = np.flatnonzero((classes == QUOTE) & (before == START))
    unclosed = closing == QUOTED
    problem[unclosed] = "unterminated quote"
    latest = np.full(count, -1, dtype=np.int64)
    latest[row[opens]] = opens
    offset[unclosed] = (latest - starts)[unclosed]
    for state, reason in ((STRAY_QUOTE, "quote in a bare field"), (TRAILING, "text after a closing quote")):
        bad = closing == state
        problem[bad] = reason
    after = TRANSITIONS[classes, before]
    faults = np.flatnonzero((after >= STRAY_QUOTE) & (before < STRAY_QUOTE))
    offset[row[faults]] = faults - starts[row[faults]]
    problem[void], offset[void] = "null line", 0

    # Bytes that belong to a field's content, then the fields' bounds among them.
    keep = (
        ((before == START) & (classes == OTHER))
        | ((before == BARE) & ((classes == OTHER) | (classes == BLANK)))
        | ((before == QUOTED) & (classes != QUOTE) & (classes != END))
        | ((before == CLOSING) & (classes == QUOTE))
    )
    kept = np.concatenate([[0], np.cumsum(keep)])
    out: dict[str, pa.Array] = {}
    sound = problem == None  # noqa: E711
    cuts = np.flatnonzero(splits & sound[row]).reshape(-1, width - 1) if sound.any() else np.zeros((0, width - 1), dtype=np.int64)
    left = np.concatenate([starts[sound][:, None], cuts + 1], axis=1)
    right = np.concatenate([cuts, stop[sound][:, None]], axis=1)
    content = buffer[keep].tobytes()
    lengths = np.zeros((count, width), dtype=np.int64)
    lengths[sound] = kept[right] - kept[left]
    text = np.frombuffer(content, dtype=np.uint8)
    for k in range(width):
        size = lengths[:, k]
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        first = np.zeros(count, dtype=np.int64)
        first[sound] = kept[left[:, k]]
        take = np.repeat(first - at[:-1], size) + np.arange(at[-1])
        mask = np.packbits(sound, bitorder="little").tobytes()
        array = pa.Array.from_buffers(pa.large_string(), count, [pa.py_buffer(mask), pa.py_buffer(at.tobytes()), pa.py_buffer(text[take].tobytes())])
        out[f"f{k}"] = array.cast(pa.string())
    begins = np.zeros((count, width), dtype=np.int64)
    begins[sound] = left - starts[sound][:, None]
    for k in range(width):
        out[f"at{k}"] = pa.array(begins[:, k], mask=~sound)
    out["n_fields"] = pa.array(n_fields.astype(np.int32))
    out["problem"] = pa.array(problem.tolist(), type=pa.string())
    out["offset"] = pa.array(offset, mask=offset < 0)
    return out


def slices(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a text column (a longer line is a slice by itself), to bound the working memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass(frozen=True)
class Field:
    """A typed column: its name, and for the trimmed text the value (null if it isn't valid) and whether NA is allowed."""

    name: str
    parse: object
    nullable: bool


def _positive_int(text: Column) -> Column:
    digits = F.when(text.rlike(r"\A[0-9]+\z"), F.regexp_replace(text, r"\A0+(?=[0-9])", ""))
    number = F.when(F.length(digits) <= 10, digits).try_cast("bigint")
    return F.when(number.between(1, 2_147_483_647), number.cast("int"))


def _timestamp(text: Column) -> Column:
    shape = r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?\z"
    return F.when(text.rlike(shape), text).try_cast("timestamp_ntz")


def _unit_interval(text: Column) -> Column:
    number = F.when(text.rlike(r"\A([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), text).try_cast("double")
    return F.when(number.between(0.0, 1.0), number.cast("float"))


#: The proximity log's record.
PROXIMITY_FIELDS = (
    Field("user.id", _positive_int, False),
    Field("remote.user.id.if.known", _positive_int, True),
    Field("time", _timestamp, False),
    Field("prob2", _unit_interval, True),
)


def parse_lines(lines: DataFrame, line: str, fields: tuple[Field, ...] = PROXIMITY_FIELDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every line of ``lines``, typed or with the reason why not.

    Returns the ``carry`` columns, the typed fields (null where a line isn't
    valid), ``reason`` (null for a valid line) and ``reason_offset``: the byte
    offset in the line of the fault (for a record of too few fields its end, for
    an invalid value the beginning of its field, right after the comma before).

    A record is comma-separated; fields may be quoted, a quote inside is written
    twice; blanks (spaces, tabs) around a field and one carriage return ending
    the line carry no meaning; ``NA`` is the only mark of a missing value. Line
    breaks in quotes are content, see :func:`~driftloom.sources.records.read_records`.

    Defined cases: a null line has reason ``null line``; an empty line has one
    field and so reason ``column count``; lines of any length are read whole;
    repeated lines each count; an empty table yields no row; other columns,
    whatever their names, are ignored unless carried.
    """
    kept = [f"carry_{i}" for i in range(len(carry))]
    source = lines.select(*[F.col(c).alias(k) for c, k in zip(carry, kept)], F.col(line).alias("line"))
    raw = [f"f{i}" for i in range(len(fields))]
    schema = T.StructType(
        [source.schema[k] for k in kept]
        + [T.StructField(r, T.StringType()) for r in raw]
        + [T.StructField(f"at{i}", T.LongType()) for i in range(len(fields))]
        + [T.StructField("n_fields", T.IntegerType()), T.StructField("problem", T.StringType()), T.StructField("offset", T.LongType())]
    )
    width = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(kept)):
                tokens = tokenize(part.column(len(kept)), width)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *tokens.values()], names=[*kept, *tokens])

    tokens = source.mapInArrow(run, schema)
    # Each step's results are columns, so that the next steps don't compute them again.
    rest = [*kept, "problem", "offset", *[f"at{i}" for i in range(len(fields))]]
    trimmed = tokens.select(*rest, *[F.btrim(F.col(r), F.lit(" \t")).alias(f"t{i}") for i, r in enumerate(raw)])
    parsed = trimmed.select(
        *rest,
        *[f.parse(F.col(f"t{i}")).alias(f"v{i}") for i, f in enumerate(fields)],
        *[(F.lit(f.nullable) & (F.col(f"t{i}") == "NA")).alias(f"na{i}") for i, f in enumerate(fields)],
    )
    faults = [F.when(F.col(f"v{i}").isNull() & ~F.col(f"na{i}"), F.lit(f"invalid {f.name}")) for i, f in enumerate(fields)]
    places = [F.when(fault.isNotNull(), F.col(f"at{i}")) for i, fault in enumerate(faults)]
    typed = parsed.withColumn("reason", F.coalesce(F.col("problem"), *faults)).withColumn("offset", F.coalesce("offset", *places))
    return typed.select(
        *[F.col(k).alias(c.strip("`")) for c, k in zip(carry, kept)],
        *[F.when(F.col("reason").isNull(), F.col(f"v{i}")).alias(f.name) for i, f in enumerate(fields)],
        "reason",
        F.col("offset").alias("reason_offset"),
    )


def with_reason(parsed: DataFrame, rejected: bool = True) -> DataFrame:
    """The lines with a reason (or those without).

    A plain filter would be pushed below the typing and repeat it for each
    column that the reason depends on; the row's number, which can't be moved,
    keeps it above.
    """
    kept = F.col("reason").isNotNull() if rejected else F.col("reason").isNull()
    return parsed.withColumn("_row", F.monotonically_increasing_id()).filter(kept & (F.col("_row") >= 0)).drop("_row")


def split_lines(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the rejected lines with reason and offset."""
    typed = [c for c in parsed.columns if c not in ("reason", "reason_offset")]
    names = {f.name for f in PROXIMITY_FIELDS}
    good = with_reason(parsed, False).select(*[f"`{c}`" for c in typed])
    bad = with_reason(parsed).select(*[f"`{c}`" for c in typed if c not in names], "reason", "reason_offset")
    return good, bad


__all__ = ["PEER", "USER", "Field", "PROXIMITY_FIELDS", "parse_lines", "split_lines", "with_reason", "states_before", "tokenize"]
