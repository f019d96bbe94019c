"""Question-and-answer passes between blocks of documents and buckets of hashed keys.

Documents are dealt to blocks of a few megabytes by a hash of their id. In a pass every block
sends, for each bucket, one packed row of distinct keys with what it knows about them (so a key
that a third of all documents hold arrives once per block, not once per document); a bucket
sees all blocks' entries for its keys and answers each block with one packed row. The text is
shuffled by block once; all passes over it read that same shuffle (identical exchanges are
reused by Spark).

Rows: bucket, block, kind, a, b, c (packed NumPy arrays). Rows of kind ECHO go through a
bucket unchanged, which hands a block's earlier answers on to its next pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.bytesops import trim, unpacked

ECHO = -1
MESSAGE = "bucket int, block int, kind int, a binary, b binary, c binary"
_NAMES = ["bucket", "block", "kind", "a", "b", "c"]
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

Message = tuple[int, int, int, bytes, bytes, bytes]


def text_size(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def dealt(docs: DataFrame, n_blocks: int) -> DataFrame:
    """docs with the block of each row."""
    return docs.select(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(n_blocks)).cast("int").alias("block"), *docs.columns)


def table(messages: list[Message]) -> pa.Table:
    columns = list(zip(*messages, strict=True)) if messages else [()] * 6
    out = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)
    trim()
    return out


def ask(blocks: DataFrame, emit: Callable[[int, pa.Table, list[Message]], list[Message]], answers: DataFrame | None = None) -> DataFrame:
    """Messages of every block, from its documents and the answers it has had."""
    if answers is None:

        def first(rows: pa.Table) -> pa.Table:
            return table(emit(rows.column("block")[0].as_py(), rows, []))

        return blocks.groupBy("block").applyInArrow(first, MESSAGE)

    def later(rows: pa.Table, got: pa.Table) -> pa.Table:
        return table(emit(rows.column("block")[0].as_py(), rows, messages(got)) if rows.num_rows else [])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(later, MESSAGE)


def messages(rows: pa.Table) -> list[Message]:
    return list(zip(*(rows.column(n).to_pylist() for n in _NAMES), strict=True)) if rows.num_rows else []


def answer(asked: DataFrame, reply: Callable[[list[Message]], list[Message]]) -> DataFrame:
    """Every bucket's answers to the blocks."""

    def run(rows: pa.Table) -> pa.Table:
        got = messages(rows)
        echo = [m for m in got if m[2] == ECHO]
        return table(echo + reply([m for m in got if m[2] != ECHO]))

    return asked.groupBy("bucket").applyInArrow(run, MESSAGE)


def finish(blocks: DataFrame, answers: DataFrame, make: Callable[[pa.Table, list[Message]], pa.Table], schema: str) -> DataFrame:
    """The last pass: rows made from a block's documents and its answers."""
    empty = make(None, [])

    def run(rows: pa.Table, got: pa.Table) -> pa.Table:
        return make(rows, messages(got)) if rows.num_rows else empty

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def split(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes) of ascending keys, cut by the keys' high bits."""
    cuts = np.searchsorted(keys, bucket_starts(n_buckets))
    for b, (i, j) in enumerate(zip(cuts, np.append(cuts[1:], len(keys)), strict=True)):
        if j > i:
            yield b, slice(int(i), int(j))


def bucket_starts(n: int) -> np.ndarray:
    return np.array([(i << 64) // n for i in range(n)], np.uint64)


def member(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values occur in the ascending array."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ascending, values)
    at[at == len(ascending)] = 0
    return ascending[at] == values


def joined(parts: list[bytes]) -> np.ndarray:
    """The packed 64-bit arrays as one ascending array."""
    return np.sort(np.concatenate([unpacked(p) for p in parts])) if parts else np.zeros(0, np.uint64)
