"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are normalised to `` w1 w2 ... wn `` (words of ``bytesops``, one space around each), so
a word-aligned window of a benchmark item is a plain byte string and the multi-pattern search
of Wu and Manber finds it: patterns of a length class share the shortest length m; a shift
table over blocks of B bytes says how far the search window may jump; where the shift is
zero, a bucket keyed by the window's outer bytes selects the patterns, and a direct comparison
confirms them. Many stretches of text are searched in lockstep with NumPy.

No shuffle takes place. Patterns travel to the executors in groups of about ``group_bytes`` of
benchmark text. One worker searches all groups in turn, for some megabytes of documents at a
time, and holds the tables of one group only; it returns merged ranges of words and distinct items,
never single occurrences. The driver sees one group at a time as well.

Defined results: null and word-free texts and items have no words and no hits; every row of
``documents`` gives one row, repeated rows included; empty tables give empty results (an
empty benchmark: no hits); extra columns are ignored (columns named like the operator's own, ``WORDS``,
``HITS`` and ``ITEMS``, are replaced); an item with a null id marks words but is not listed; items of equal id are
one; ids of any type count as strings. A very long text is searched in one piece, in lanes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.bytesops import LOWER, slices, text_buffers, trim, word_bounds

WINDOW = 10
GROUP_BYTES = 16 << 20
LANE = 512


def normalised(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of `` w1 w2 ... wn `` + NUL for every row, place of each word, row of each word."""
    start, stop, row = word_bounds(buf, offsets)
    n_rows = len(offsets) - 1
    size = stop - start
    # every word takes its bytes and the space before it; every row two bytes more at its end
    at = np.cumsum(size + 1) - size + 2 * row
    out = np.full(int(size.sum()) + len(size) + 2 * n_rows, 0x20, np.uint8)
    ends = np.cumsum(np.bincount(row, weights=size + 1, minlength=n_rows).astype(np.int64) + 2)
    out[ends - 1] = 0
    if len(size):
        source = np.zeros(len(buf) + 1, np.int8)
        source[start] = 1
        source[stop] -= 1
        inside = np.cumsum(source[:-1], dtype=np.int8).astype(bool)
        goal = np.ones(int(size.sum()), np.int64)
        goal[0] = at[0]
        head = np.cumsum(size)[:-1]
        goal[head] = at[1:] - (at[:-1] + size[:-1]) + 1
        out[np.cumsum(goal)] = LOWER[buf[inside]]
    return out, at, row


@dataclass
class PatternClass:
    """Wu-Manber tables of patterns of similar length."""

    m: int
    block: int
    shift: np.ndarray
    keys: np.ndarray
    bucket: dict[int, list[int]] = field(default_factory=dict)


#: Entries of a shift table: far more than blocks of one group of patterns, so that most are free.
TABLE_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FRONT = 8


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes that end at each place, as numbers (zeros before the start)."""
    padded = np.concatenate([np.zeros(_FRONT - 1, np.uint8), buf])
    return np.ndarray(len(buf), np.uint64, padded, strides=(1,))


def block_codes(eight: np.ndarray, block: int) -> np.ndarray:
    """Table places of the last ``block`` of eight bytes."""
    return ((eight >> np.uint64(8 * (8 - block))) * _SPREAD) >> np.uint64(64 - TABLE_BITS)


def outer_keys(buf: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    """64-bit keys of the windows at ``start``: their first and last eight bytes."""
    take = sorted({*range(min(8, m)), *range(max(0, m - 8), m)})
    key = np.zeros(len(start), np.uint64)
    for i in take:
        key = key * np.uint64(0x100000001B3) + buf[start + i]
    return key


class WuManber:
    """Tables for a set of byte patterns; ``search`` gives (place, pattern) of all occurrences."""

    #: Lower ends of the length classes: short patterns would spoil the jumps of long ones.
    CLASSES = (1, 12, 32, 64)

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.classes = []
        for lo, hi in zip(self.CLASSES, (*self.CLASSES[1:], 1 << 62), strict=True):
            ids = [i for i, p in enumerate(patterns) if lo <= len(p) < hi]
            if ids:
                self.classes.append(self._tables(ids))

    def _tables(self, ids: list[int]) -> PatternClass:
        m = min(len(self.patterns[i]) for i in ids)
        block = min(8, max(1, m // 2))
        flat = np.frombuffer(b"".join(self.patterns[i][:m] for i in ids), np.uint8).reshape(len(ids), m)
        shift = np.full(1 << TABLE_BITS, min(m - block + 1, 30_000), np.int16)
        eight = words_at(flat.ravel()).reshape(len(ids), m)
        for q in range(block - 1, m):
            np.minimum.at(shift, block_codes(eight[:, q], block), min(m - 1 - q, 30_000))
        keys = outer_keys(flat.ravel(), np.arange(len(ids)) * m, m)
        out = PatternClass(m, block, shift, np.unique(keys))
        for i, k in zip(ids, keys.tolist(), strict=True):
            out.bucket.setdefault(k, []).append(i)
        return out

    def search(self, buf: np.ndarray) -> Iterator[tuple[int, int]]:
        text = buf.tobytes()
        eight = words_at(buf)
        for c in self.classes:
            start = self._candidates(buf, eight, c)
            if not len(start):
                continue
            key = outer_keys(buf, start, c.m)
            hit = c.keys[np.minimum(np.searchsorted(c.keys, key), len(c.keys) - 1)] == key
            for s, k in zip(start[hit].tolist(), key[hit].tolist(), strict=True):
                for i in c.bucket[k]:
                    p = self.patterns[i]
                    if text[s : s + len(p)] == p:
                        yield s, i

    @staticmethod
    def _candidates(buf: np.ndarray, eight: np.ndarray, c: PatternClass) -> np.ndarray:
        """Starts of the windows whose last block allows no shift."""
        last = len(buf) - c.m
        if last < 0:
            return np.zeros(0, np.int64)
        pos = np.arange(0, last + 1, LANE, dtype=np.int64)
        end = np.minimum(pos + LANE, last + 1) + c.m - 1
        pos += c.m - 1
        found = []
        while len(pos):
            step = c.shift[block_codes(eight[pos], c.block)]
            stay = step == 0
            if stay.any():
                found.append(pos[stay] - (c.m - 1))
            pos = pos + np.maximum(step, 1)
            live = pos < end
            if not live.all():
                pos, end = pos[live], end[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def item_windows(rows: list, window: int) -> tuple[list[bytes], list[int], list[list]]:
    """Distinct window strings of (item_id, text) rows, words in each, items of each."""
    known: dict[bytes, int] = {}
    lengths: list[int] = []
    items: list[list] = []
    for item_id, text in rows:
        buf = np.frombuffer((text or "").encode(), np.uint8)
        start, stop, _ = word_bounds(buf, np.array([0, len(buf)], np.int64))
        low = LOWER[buf].tobytes()
        words = [low[a:b] for a, b in zip(start, stop, strict=True)]
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            p = b" " + b" ".join(words[i : i + n]) + b" "
            j = known.setdefault(p, len(known))
            if j == len(lengths):
                lengths.append(n)
                items.append({})
            items[j][item_id] = None
    return list(known), lengths, [list(x) for x in items]


WORDS, HITS, ITEMS = "__n_words", "__hits", "__items"
HIT = "array<struct<start:int,stop:int>>"
#: Bytes of text that are searched for one group after the other.
SPAN_BYTES = 8 << 20


class Found:
    """What the groups find in some rows: words hit and items."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.buf, self.at, self.row = normalised(data, offsets)
        m = len(offsets) - 1
        self.n_words = np.bincount(self.row, minlength=m)
        self.first = np.searchsorted(self.row, np.arange(m + 1))
        self.change = np.zeros(len(self.at) + 1, np.int32)
        self.items: list[dict] = [{} for _ in range(m)]

    def add(self, engine: WuManber, lengths: list[int], items: list[list]) -> None:
        got = list(engine.search(self.buf))
        if not got:
            return
        place, p = np.array(got, np.int64).T
        w = np.searchsorted(self.at, place + 1)
        np.add.at(self.change, w, 1)
        np.add.at(self.change, w + np.array(lengths)[p], -1)
        for r, q in set(zip(self.row[w].tolist(), p.tolist(), strict=True)):
            self.items[r].update(dict.fromkeys(items[q]))

    def hits(self) -> list[list[dict]]:
        """The merged ranges of words hit, by row."""
        hit = np.cumsum(self.change[:-1]) > 0
        out: list[list[dict]] = [[] for _ in self.items]
        for r in np.unique(self.row[hit]).tolist():
            own = hit[self.first[r] : self.first[r + 1]]
            edge = np.flatnonzero(np.diff(own, prepend=False, append=False))
            out[r] = [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
        return out


def _searcher(groups: list):
    """mapInArrow function: the rows again, with their number of words and the hits of all groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            n_words, hits, items = [], [], []
            for i, j in slices(offsets, SPAN_BYTES):
                spans = [(a + i, b + i) for a, b in slices(offsets[i : j + 1] - offsets[i])]
                found = [Found(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in spans]
                for g in groups:
                    engine, lengths, owners = g.value
                    for f in found:
                        f.add(engine, lengths, owners)
                    if len(groups) > 1:
                        del engine, owners
                        vars(g).pop("_value", None)  # one group's tables at a time
                for f in found:
                    n_words += f.n_words.tolist()
                    hits += f.hits()
                    items += [sorted(k for k in x if k is not None) for x in f.items]
            new = {WORDS: pa.array(n_words, pa.int32()), HITS: pa.array(hits, hit_type), ITEMS: pa.array(items, pa.list_(pa.string()))}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)
            trim()

    return run


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with the columns __n_words, __hits (merged ranges of words hit) and __items (ids of items that occur, as strings)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // group_bytes))
    groups = []
    for g in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g)
        patterns, lengths, owners = item_windows([tuple(r) for r in part.collect()], window)
        groups.append(spark.sparkContext.broadcast((WuManber(patterns), lengths, owners)))
    out = docs.withColumns({WORDS: F.lit(0), HITS: F.expr(f"cast(array() as {HIT})"), ITEMS: F.expr("cast(array() as array<string>)")})
    return out.mapInArrow(_searcher(groups), out.schema)


def covered() -> str:
    """SQL for the number of words in any of the ranges."""
    return f"aggregate({HITS}, 0L, (n, x) -> n + x.stop - x.start)"


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document with the digest columns of its contamination."""
    found = find_windows(docs.select("doc_id", "text"), benchmark, **options).drop("text")
    ids = found.withColumnRenamed(ITEMS, "ids")
    return ids.select(
        "doc_id",
        F.col(WORDS).cast("long").alias("n_words"),
        F.expr(covered()).alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"),
        F.expr(f"{covered()} > 0").alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all columns as they are."""
    clash = {c: f"__kept{c}" for c in (WORDS, HITS, ITEMS) if c in docs.columns}
    clean = find_windows(docs.withColumnsRenamed(clash), benchmark, **options).filter(F.size(HITS) == 0).drop(WORDS, HITS, ITEMS)
    return clean.withColumnsRenamed({v: k for k, v in clash.items()})


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of ten words."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
