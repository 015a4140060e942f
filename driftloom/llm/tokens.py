"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def default_vocabulary() -> str:
    """Path of the multilingual byte-level vocabulary that comes with the environment."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """A byte-level BPE encoder from a file of ranks."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_sizes(documents: DataFrame, text: str, keep: tuple[str, ...], vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """The ``keep`` columns of the rows with a non-null text, and ``size``, its number of tokens.

    The vocabulary file must be readable at the same path on every executor.
    Whole texts are encoded, of any length; an empty text has size 0.
    """
    import public_tokenizers

    path, shape = vocabulary or default_vocabulary(), pattern or public_tokenizers.PATTERN
    kept = [f"keep_{i}" for i in range(len(keep))]
    rows = documents.filter(F.col(text).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(text).alias("text"))
    schema = T.StructType([rows.schema[k] for k in kept] + [T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, shape).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py())) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, pa.int64())], names=[*kept, "size"])

    return rows.mapInArrow(run, schema).select(*[F.col(k).alias(c.strip("`")) for c, k in zip(keep, kept)], "size")
