"""Repeated passages of at least ``threshold`` bytes, by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``threshold`` bytes (windows), by passes over
digits, most significant first; a group that has one member leaves, so later passes see only what
may repeat. A window's digits are taken in an order that suits a cluster:

1. its anchor, the k-gram of least hash in the window (the leftmost, if several). All windows
   of a document with the same anchor are consecutive and move as one unit, so this pass sorts
   about 2/(w+1) entries a byte, w = threshold - k + 1, instead of one a byte;
2. the unit, the bytes from the first to the last window of the anchor. A unit that a smaller
   document has as well is settled: all its windows repeat;
3. for units that are alone but share their anchor, the windows themselves, to full depth.

Equal groups after these passes are exactly the equal windows (up to collisions of 64-bit
hashes). Only the smallest document of a group of equal entries matters, so entries are
pre-aggregated per block (see ``blocks``) and no group is ever expanded into pairs.

Defined results: a null text is empty; a null id counts as larger than all others; rows of equal
id never remove each other's bytes; repeated rows give equal results; empty tables give empty
results; extra columns are ignored. Offsets are bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import blocks as B
from tracewell.llm.bytesops import BYTE_CODE, mix, owners, packed, prefix_sums, raw_span_hash, slices, text_buffers, unpacked

THRESHOLD = 50
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
CHUNK = 1 << 18
_LAST = np.iinfo(np.int64).max


@dataclass
class Units:
    """The anchors of a block: hash of the k-gram, unit hash, first and last window, row."""

    gram: np.ndarray
    unit: np.ndarray
    first: np.ndarray
    last: np.ndarray
    row: np.ndarray


def gram_size(threshold: int) -> int:
    return max(1, 2 * threshold // 5)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    size, best = 1, x
    while size * 2 <= w:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    rest = w - size
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def analyse(data: np.ndarray, offsets: np.ndarray, threshold: int) -> Units:
    k = gram_size(threshold)
    w = threshold - k + 1
    parts: list[tuple] = []
    for i, j in slices(offsets, CHUNK):
        lo, hi = int(offsets[i]), int(offsets[j])
        for a in range(lo, max(lo + 1, hi), CHUNK):  # more than one turn only for a text beyond CHUNK
            b = min(hi, a + CHUNK + threshold - 1)
            if b - a >= threshold:
                parts.append(_analyse(data[a:b], a, offsets[i : j + 1], i, threshold, k, w))
    if not parts:
        z = np.zeros(0, np.int64)
        return Units(z.view(np.uint64), z.view(np.uint64), z, z, z)
    return Units(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _analyse(buf, base, offsets, row0, threshold, k, w):
    n = len(buf)
    sums = prefix_sums(BYTE_CODE[buf])
    at = np.arange(n - k + 1)
    gram = mix(raw_span_hash(sums, at, at + k))
    low = np.uint64((1 << 24) - 1)
    best = sliding_min((gram & ~low) | at.astype(np.uint64), w)  # one for each window start
    anchor = (best & low).astype(np.int64)
    local = np.clip(offsets - base, 0, n)
    sizes = np.diff(local)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    where = np.flatnonzero(np.repeat(local[1:], sizes)[: len(anchor)] >= at[: len(anchor)] + threshold)
    a, r = anchor[where], row[where]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    heads = np.flatnonzero(new)
    first = where[heads]
    last = where[np.append(heads[1:], len(a)) - 1]
    a = a[heads]
    shape = (a - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64)
    unit = mix(raw_span_hash(sums, first, last + threshold) + mix(shape))
    # anchors are least hashes, so nearly all are small numbers: mixed again, they spread evenly over the buckets
    return mix(gram[a]), unit, first + base, last + base, r[heads] + row0


def windows(data: np.ndarray, first: np.ndarray, last: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and owner (index into first) of all windows of some units."""
    n = last - first + 1
    owner = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    if threshold < 8:
        loads, eight = range(threshold), data
    else:  # unaligned loads of eight bytes, the last one overlapping
        loads = [*range(0, threshold - 8, 8), threshold - 8]
        eight = np.ndarray(len(data) - 7, np.uint64, np.ascontiguousarray(data), strides=(1,)) if len(data) > 7 else np.zeros(0, np.uint64)
    out = np.zeros(len(start), np.uint64)
    for j in loads:
        out = (out ^ eight[start + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out = mix(out)
    return out, start, owner


def least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, the smallest id of each, and the index of one row that has it."""
    order = np.lexsort((ids, keys))
    keys = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    return keys[head], ids[order][head], order[head]


def stacked(got, field: int, kind=np.uint64) -> np.ndarray:
    return np.concatenate([unpacked(m[field], kind) for m in got])


class Passes:
    """What blocks send and buckets answer in each pass."""

    def __init__(self, threshold: int, n_buckets: int):
        self.threshold, self.n = threshold, n_buckets

    def load(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Units]:
        data, offsets = text_buffers(rows.column("text"))
        ids = np.asarray(rows.column("doc_id").fill_null(_LAST).to_numpy(), np.int64)
        return data, offsets, ids, analyse(data, offsets, self.threshold)

    # pass 1: which anchors do other blocks have

    def ask_anchors(self, block, rows, _):
        u = self.load(rows)[3]
        keys = np.unique(u.gram)
        return [(b, block, 0, packed(keys[s]), None, None) for b, s in B.split(keys, self.n)]

    def answer_anchors(self, got):
        every = B.joined([m[3] for m in got])
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for bucket, block, _, a, _, _ in got:
            keys = unpacked(a)
            keys = keys[B.member(keys, shared)]
            if len(keys):
                out.append((bucket, block, 1, packed(keys), None, None))
        return out

    # pass 2: which units does a smaller document have, which only share their anchor

    def ask_units(self, block, rows, got):
        _, _, ids, u = self.load(rows)
        known = B.joined([m[3] for m in got])
        own, n = np.unique(u.gram, return_counts=True)
        known = np.union1d(known, own[n > 1])
        take = np.flatnonzero(B.member(u.gram, known))
        units, doc, at = least(u.unit[take], ids[u.row[take]])
        gram = u.gram[take][at]
        order = np.argsort(gram, kind="stable")
        gram, units, doc = gram[order], units[order], doc[order]
        return [(b, block, 2, packed(gram[s]), packed(units[s]), packed(doc[s])) for b, s in B.split(gram, self.n)]

    def answer_units(self, got):
        if not got:
            return []
        gram, unit, doc = stacked(got, 3), stacked(got, 4), stacked(got, 5, np.int64)
        order = np.lexsort((doc, unit, gram))
        g, u, d = gram[order], unit[order], doc[order]
        head = np.ones(len(u), bool)
        head[1:] = (u[1:] != u[:-1]) | (g[1:] != g[:-1])
        group = np.cumsum(head) - 1
        smallest = np.empty(len(u), np.int64)
        smallest[order] = d[head][group]
        g_head = np.ones(len(u), bool)
        g_head[1:] = g[1:] != g[:-1]
        g_group = np.cumsum(g_head) - 1
        several = np.empty(len(u), bool)
        several[order] = (np.bincount(g_group, weights=head) > 1)[g_group]
        out, i = [], 0
        for bucket, block, _, a, b, c in got:
            j = i + len(a) // 8
            units, late = unpacked(b), smallest[i:j] < unpacked(c, np.int64)
            out.append((bucket, block, 3, packed(units[late]), packed(units[~late & several[i:j]]), None))
            i = j
        return out

    # pass 3: which windows of the remaining units does a smaller document have

    def settled(self, got) -> tuple[np.ndarray, np.ndarray]:
        own = [m for m in got if m[2] in (3, B.ECHO)]
        return B.joined([m[3] for m in own]), B.joined([m[4] for m in own])

    def open_windows(self, data, ids, u, single, every):
        """Windows of one or of all occurrences, in the smallest document of the block, of each open unit."""
        take = np.flatnonzero(B.member(u.unit, single))
        keys, doc, at = least(u.unit[take], ids[u.row[take]])
        take = take[ids[u.row[take]] == doc[np.searchsorted(keys, u.unit[take])]] if every else take[at]
        h, start, owner = windows(data, u.first[take], u.last[take], self.threshold)
        return h, start, ids[u.row[take]][owner]

    def ask_windows(self, block, rows, got):
        data, _, ids, u = self.load(rows)
        late, single = self.settled(got)
        h, _, doc = self.open_windows(data, ids, u, single, False)
        keys, doc, _ = least(h, doc)
        out = [(b, block, 4, packed(keys[s]), packed(doc[s]), None) for b, s in B.split(keys, self.n)]
        return [*out, (block % self.n, block, B.ECHO, packed(late), packed(single), None)]

    def answer_windows(self, got):
        if not got:
            return []
        keys, doc = stacked(got, 3), stacked(got, 4, np.int64)
        every, smallest, _ = least(keys, doc)
        out = []
        for bucket, block, _, a, b, _ in got:
            own = unpacked(a)
            late = own[smallest[np.searchsorted(every, own)] < unpacked(b, np.int64)]
            if len(late):
                out.append((bucket, block, 5, packed(late), None, None))
        return out

    # the end: spans

    def spans(self, rows, got) -> pa.Table:
        names = ["doc_id", "n_bytes", "spans", "kept"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        if rows is None:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), span, pa.binary())], names=names)
        data, offsets, ids, u = self.load(rows)
        late, single = self.settled(got)
        change = np.zeros(len(data) + 1, np.int32)
        _, doc, _ = least(u.unit, ids[u.row])
        keys = np.unique(u.unit)
        whole = B.member(u.unit, late) | (ids[u.row] > doc[np.searchsorted(keys, u.unit)])
        np.add.at(change, u.first[whole], 1)
        np.add.at(change, u.last[whole] + self.threshold, -1)
        h, start, owner = self.open_windows(data, ids, u, single, True)
        if len(h):
            keys, doc, _ = least(h, owner)
            hit = B.member(h, B.joined([m[3] for m in got if m[2] == 5])) | (owner > doc[np.searchsorted(keys, h)])
            np.add.at(change, start[hit], 1)
            np.add.at(change, start[hit] + self.threshold, -1)
        gone = np.cumsum(change[:-1]) > 0
        begin, end = np.flatnonzero(gone & ~shifted(gone, offsets, True)), np.flatnonzero(gone & ~shifted(gone, offsets, False)) + 1
        owner = owners(begin, offsets)
        base = offsets[owner]
        cuts = np.searchsorted(owner, np.arange(len(offsets)))
        flat = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], names=["start", "stop"])
        kept = data[~gone]
        left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary())
        return pa.Table.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), flat), text], names=names)


def shifted(gone: np.ndarray, offsets: np.ndarray, before: bool) -> np.ndarray:
    """Whether the byte before (after) each byte, in the same row, is gone."""
    out = np.zeros_like(gone)
    inner = offsets[1:-1]
    if before:
        out[1:] = gone[:-1]
        out[inner[inner < len(gone)]] = False
    else:
        out[:-1] = gone[1:]
        out[inner[inner > 0] - 1] = False
    return out


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, the removed ``spans`` and the ``kept`` bytes of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    size = B.text_size(docs)
    dealt = B.dealt(docs, max(1, -(-size // block_bytes)))
    p = Passes(threshold, max(1, -(-size // bucket_bytes)))
    anchors = B.answer(B.ask(dealt, p.ask_anchors), p.answer_anchors)
    units = B.answer(B.ask(dealt, p.ask_units, anchors), p.answer_units)
    wins = B.answer(B.ask(dealt, p.ask_windows, units), p.answer_windows)
    return B.finish(dealt, wins, p.spans, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents in passages of fifty bytes that a smaller document has."""
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
