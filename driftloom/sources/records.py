"""Records of delimited files, read in parallel from byte ranges, line breaks inside quotes included.

Whether a line break ends a record depends on whether it stands in quotes, which
depends on everything before it. So files are cut into chunks anywhere:

1. for each chunk its transition function is computed: the tokenizer's state at
   its end for each state at its start;
2. the functions of a file's chunks are composed in order (a few bytes per
   chunk), which gives the state each chunk starts in;
3. each chunk is read again from its known state and yields the records that
   begin in it; the last one is read to its end in the chunks after.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.sources.dsv import BLANK, COMMA, END, N_STATES, OTHER, QUOTE, QUOTED, START, TRANSITIONS

#: As for single lines, but a line break in quotes is content.
ACROSS = TRANSITIONS.copy()
ACROSS[END, QUOTED] = QUOTED
CLASSES = np.full(256, OTHER, dtype=np.uint8)
CLASSES[[ord(","), ord('"'), ord(" "), ord("\t"), ord("\n")]] = [COMMA, QUOTE, BLANK, BLANK, END]
AFTER = pa.schema([("path", pa.string()), ("length", pa.int64()), ("offset", pa.int64()), ("after", pa.list_(pa.int32()))])
#: Bytes of one pass through the automaton.
STEP = 4_000_000


def _read(path: str, offset: int, length: int) -> bytes:
    # Hadoop writes local paths with one slash.
    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    with system.open_input_file(name) as file:
        return file.read_at(length, offset)


def transition(data: bytes, block: int = 256) -> np.ndarray:
    """The state at the end of ``data`` for each state at its start."""
    classes = CLASSES[np.frombuffer(data, dtype=np.uint8)]
    whole = len(classes) // block
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (whole, 1))
    for step in classes[: whole * block].reshape(whole, block).T:
        maps = ACROSS[step[:, None], maps]
    # Composed two by two.
    while len(maps) > 1:
        odd = maps[-1:] if len(maps) % 2 else maps[:0]
        maps = np.concatenate([np.take_along_axis(maps[1::2], maps[0 : len(maps) // 2 * 2 : 2], axis=1), odd])
    out = maps[0] if len(maps) else np.arange(N_STATES, dtype=np.uint8)
    for c in classes[whole * block :]:
        out = ACROSS[c, out]
    return out


def breaks(data: bytes, state: int, block: int = 256) -> tuple[np.ndarray, int]:
    """Where records end in ``data`` (positions of their line breaks) if it starts in ``state``, and the state at its end."""
    classes = CLASSES[np.frombuffer(data, dtype=np.uint8)]
    n = len(classes)
    blocks = -(-n // block)
    padded = np.full(blocks * block, OTHER, dtype=np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(blocks, block).T)
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (blocks, 1))
    for step in steps:
        maps = ACROSS[step[:, None], maps]
    starts = np.empty(blocks, dtype=np.uint8)
    at = state
    for i, m in enumerate(maps.tolist()):
        starts[i] = at
        at = m[at]
    before = np.empty((block, blocks), dtype=np.uint8)
    now = starts
    for j, step in enumerate(steps):
        before[j] = now
        now = ACROSS[step, now]
    before = before.T.ravel()[:n]
    last = int(ACROSS[classes[-1], before[-1]]) if n else state
    return np.flatnonzero((classes == END) & (before != QUOTED)), last


def read_records(spark: SparkSession, path: str, header: bool = True, chunk_bytes: int = 32_000_000) -> DataFrame:
    """``file_name, byte_offset, raw_line``: the records of the files under ``path`` (of UTF-8 text), without their line breaks.

    ``raw_line`` suits :func:`~driftloom.sources.dsv.parse_lines`; ``byte_offset``
    is where the record begins in its file. With ``header`` a file's first record
    is left out.

    Defined cases: an empty file has no record; a last record without a line
    break counts; an empty line is a record; bytes that aren't UTF-8 come out as
    replacement characters; a record may be longer than a chunk. A quote that is
    never closed takes everything up to the next quote into its record, as
    nothing tells line breaks in quotes from others.
    """
    if chunk_bytes < 1:
        raise ValueError("chunk_bytes must be positive")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    chunk = F.lit(chunk_bytes).cast("bigint")
    chunks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, chunk)).alias("offset"))
    # Chunks are few bytes of work to plan and many to read: each is sent to a task by itself.
    chunks = chunks.repartition(F.col("path"), F.col("offset"))

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = np.arange(N_STATES, dtype=np.uint8)
                end = min(row["offset"] + chunk_bytes, row["length"])
                for at in range(row["offset"], end, STEP):
                    out = transition(_read(row["path"], at, min(STEP, end - at)))[out]
                yield pa.RecordBatch.from_pylist([{**row, "after": out.tolist()}], AFTER)

    known = chunks.mapInArrow(functions, "path string, length bigint, offset bigint, after array<int>")

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        state, states = START, []
        for after in table.column("after").to_pylist():
            states.append(state)
            state = after[state]
        return table.drop_columns(["after"]).append_column("state", pa.array(states, pa.int32()))

    placed = known.groupBy("path").applyInArrow(compose, "path string, length bigint, offset bigint, state int")
    placed = placed.repartition(F.col("path"), F.col("offset"))

    def cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _records(row["path"], row["offset"], min(row["offset"] + chunk_bytes, row["length"]), row["length"], row["state"], header)

    return placed.mapInArrow(cut_records, "file_name string, byte_offset bigint, raw_line string")


def _records(path: str, start: int, end: int, length: int, state: int, header: bool) -> Iterator[pa.RecordBatch]:
    """The records of a file that begin in [start, end)."""
    # A record begins at the file's start and after each line break that ends one; whether one ends right before is read off the byte there.
    begins = start == 0 or (state == START and _read(path, start - 1, 1) == b"\n")
    open_at: int | None = start if begins else None
    rest = b""
    at = start
    while at < length and (at < end or open_at is not None):
        data = _read(path, at, min(STEP, length - at))
        ends, state = breaks(data, state)
        found, offsets = [], []
        from_ = 0
        for e in ends.tolist():
            if open_at is not None:
                found.append(rest + data[from_:e])
                offsets.append(open_at)
                rest = b""
            from_ = e + 1
            open_at = at + from_ if at + from_ < end else None
            if open_at is None:
                break
        if open_at is not None:
            rest += data[from_:]
        at += len(data)
        yield _batch(path, offsets, found, header)
    if open_at is not None and open_at < length:
        yield _batch(path, [open_at], [rest], header)


def _batch(path: str, offsets: list[int], found: list[bytes], header: bool) -> pa.RecordBatch:
    kept = [(o, r) for o, r in zip(offsets, found) if not (header and o == 0)]
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(kept), pa.string()), pa.array([o for o, _ in kept], pa.int64()), pa.array([r.decode("utf-8", "replace") for _, r in kept], pa.string())],
        names=["file_name", "byte_offset", "raw_line"],
    )
