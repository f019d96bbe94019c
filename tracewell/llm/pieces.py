"""Sampled piece segmentation by forward filtering and backward sampling, and its decoding.

The vocabulary is that of a sentencepiece model file (its path is a parameter; never trained
here). Every text, with one blank put before it, is a lattice whose edges are pieces; an edge
of the piece with rank r weighs (r + 2) ** -alpha (a Zipf law of the ranks, which are what a
merge vocabulary stores). Forward filtering sums the weights of all paths to each place;
backward sampling then walks from the end and draws each piece with its exact conditional
probability. Draws come from a counter-based generator keyed by (seed, row key, place), so a
row's segmentation does not depend on partitions, batches or retries.

Where no piece of the vocabulary can reach across, at the start of a run of blanks or around a line
end, the lattice falls apart into units, and equal units share one forward pass. Units of more than
``UNIT`` bytes (text without blanks) keep their whole lattice: their forward sums are scaled as they go and
kept, one number a byte, and backward sampling finds the pieces that end at a place again, from
right to left. So no place is a border by itself, however long the unit.

A code point outside the vocabulary is spelt with the byte pieces, as is the blank symbol itself
when a text contains it; so decoding is lossless for every text: pieces give bytes, blanks are
blanks, and the first blank goes.

Defined results: a null text gives null ids and decodes to null; an empty text gives no ids;
repeated rows give equal results; a null key is a key of its own; other columns are ignored.
No shuffle takes place; the vocabulary, of fixed size, is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.bytesops import mix, owners, prefix_sums, slices, span_hash, text_buffers, trim

#: Units of at most so many bytes keep the edges of their lattice.
UNIT = 48
#: Bytes encoded together, and distinct units of a lattice.
SLICE, LATTICE = 2 << 20, 1 << 14
#: Units whose paths are drawn together, and ids decoded together: what a worker holds for them is a few dozen bytes each.
DRAWS = 1 << 16
DIRECT = 4096
BLANK = "▁"
SEED = 1
ALPHA = 1.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces as byte strings, a trie over them as sorted (node, byte) keys, and edge weights."""

    def __init__(self, model_file: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.strings = [b""] * n
        self.byte_ids = np.full(256, -1, np.int32)
        ranks = {}
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value] = i
                self.strings[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.strings[i] = sp.id_to_piece(i).replace(BLANK, " ").encode()
                ranks[i] = -sp.get_score(i)
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        self.weight = np.zeros(n)
        for i, r in ranks.items():
            self.weight[i] = (r + 2.0) ** -alpha
        self.byte_weight = (n + 2.0) ** -alpha
        nodes: dict[tuple[int, int], int] = {}
        self.piece_at = [-1]
        # borders hold if no piece crosses them
        self.cut_blanks = not any(b" " in self.strings[i].lstrip(b" ") for i in ranks)
        self.cut_lines = not any(b"\n" in self.strings[i] and len(self.strings[i]) > 1 for i in ranks)
        self.longest = max((len(self.strings[i]) for i in ranks), default=1)
        self.ranks = list(ranks)
        self._reverse = None
        for i in ranks:
            s = self.strings[i]
            node = 0
            for b in s:
                node = nodes.setdefault((node, b), len(nodes) + 1)
                if node == len(self.piece_at):
                    self.piece_at.append(-1)
            self.piece_at[node] = i
        self.piece_at = np.array(self.piece_at, np.int32)
        keys = np.array([a * 256 + b for a, b in nodes], np.int32)
        order = np.argsort(keys)
        self.keys, self.goal = keys[order], np.array(list(nodes.values()), np.int32)[order]
        # the first nodes come from the commonest pieces: their moves are looked up directly
        near = self.keys < DIRECT * 256
        self.direct = np.full(DIRECT * 256, -1, np.int32)
        self.direct[self.keys[near]] = self.goal[near]
        self.sizes = np.array([len(s) for s in self.strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.strings), np.uint8)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next trie node, or -1."""
        key = (node << 8) | byte  # node and key fit 32 bits
        out = self.direct[np.minimum(key, DIRECT * 256 - 1)]
        far = np.flatnonzero(node >= DIRECT)
        if len(far):
            k = key[far]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            out[far] = np.where(self.keys[at] == k, self.goal[at], -1)
        return out

    def __getstate__(self):
        return self.__dict__ | {"_reverse": None}

    def reverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, goals and pieces of the trie of the pieces read from right to left."""
        if self._reverse is None:
            nodes: dict[tuple[int, int], int] = {}
            piece = {}
            for i in self.ranks:
                node = 0
                for b in reversed(self.strings[i]):
                    node = nodes.setdefault((node, b), len(nodes) + 1)
                piece[node] = i
            keys = np.array([a * 256 + b for a, b in nodes], np.int64)
            order = np.argsort(keys)
            at = np.full(len(nodes) + 1, -1, np.int32)
            for node, i in piece.items():
                at[node] = i
            self._reverse = keys[order], np.array(list(nodes.values()), np.int64)[order], at
        return self._reverse

    # -- encoding ---------------------------------------------------------------------------

    def encode(self, buf: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all rows and the offsets of each row's ids."""
        sizes = np.diff(offsets)
        lead = (sizes > 0).astype(np.int64)
        ends = np.cumsum(sizes + lead)
        starts = ends - sizes - lead
        text = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(sizes) + 1, np.int64)
        own = np.ones(len(text), bool)
        own[starts[lead > 0]] = False
        text[own] = buf
        del own
        u_start, u_stop = units(text, starts[lead > 0], self.cut_blanks, self.cut_lines)
        size = u_stop - u_start
        _, sample, kind = np.unique(unit_hashes(text, u_start, u_stop), return_index=True, return_inverse=True)
        by_size = np.argsort(size[sample], kind="stable")
        place = np.empty(len(by_size), np.int32)
        place[by_size] = np.arange(len(by_size))
        kind, sample = place[kind], sample[by_size]
        chosen = np.full(len(text), -1, np.int32)
        seeds = mix(keys.view(np.uint64) + mix(np.array([seed], np.uint64)))
        rows_with = np.flatnonzero(lead)
        bounds = np.append(starts[rows_with], len(text))
        u_row = owners(u_start, bounds).astype(np.int32)
        begin, seeds = starts[rows_with], seeds[rows_with]
        del u_stop
        long = size[sample] > UNIT
        for some in batches_of(size[sample], np.flatnonzero(long), self.longest):
            at = np.flatnonzero(np.isin(kind, some))
            chain = LongUnits(self, text, u_start[sample[some]], size[sample[some]])
            chain.sample(np.searchsorted(some, kind[at]), u_start[at], size[at], begin[u_row[at]], seeds[u_row[at]], chosen)
        sample = sample[~long]  # the kinds are in the order of size, so the short ones are the first
        order = np.argsort(kind)[: int((~long[kind]).sum())]
        cuts = np.searchsorted(kind[order], np.arange(0, len(sample) + LATTICE, LATTICE))
        for k in range(len(cuts) - 1):
            some = sample[k * LATTICE : (k + 1) * LATTICE]
            lattice = Lattice(self, text, u_start[some], u_start[some] + size[some])
            for i in range(cuts[k], cuts[k + 1], DRAWS):
                at = order[i : min(i + DRAWS, cuts[k + 1])]
                lattice.sample(kind[at] - k * LATTICE, u_start[at], size[at], begin[u_row[at]], seeds[u_row[at]], chosen)
            del lattice
        used = np.flatnonzero(chosen >= 0)
        per_row = np.bincount(rows_with, weights=np.diff(np.searchsorted(used, bounds)), minlength=len(sizes)).astype(np.int64)
        return chosen[used], np.concatenate([[0], np.cumsum(per_row)])

    # -- decoding ---------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and their offsets."""
        sizes = self.sizes[ids]
        stop = np.cumsum(sizes)
        total = int(stop[-1]) if len(stop) else 0
        out = np.empty(total, np.uint8)
        for i in range(0, len(ids), DRAWS):
            some = slice(i, i + DRAWS)
            lo, hi = int(stop[i] - sizes[i]), int(stop[some][-1])
            out[lo:hi] = self.blob[np.arange(lo, hi) + np.repeat(self.starts[ids[some]] - (stop[some] - sizes[some]), sizes[some])]
        bounds = np.concatenate([[0], stop])[offsets]
        filled = np.diff(bounds) > 0
        keep = np.ones(total, bool)
        keep[bounds[:-1][filled]] = False  # the blank put before each text
        return out[keep], bounds - np.concatenate([[0], np.cumsum(filled)])


def units(text: np.ndarray, row_starts: np.ndarray, cut_blanks: bool = True, cut_lines: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the units: at row starts, and where no piece reaches across: before runs of blanks, around line ends."""
    blank, line = text == 0x20, text == 0x0A
    cut = line.copy() if cut_lines else np.zeros(len(text), bool)
    if cut_lines:
        cut[1:] |= line[:-1]
    if cut_blanks:
        cut[1:] |= blank[1:] & ~blank[:-1]
    cut[row_starts] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], len(text))


#: Forward sums held at once by long units.
CELLS = 1 << 21


def batches_of(size: np.ndarray, some: np.ndarray, extra: int) -> Iterator[np.ndarray]:
    """The given indexes, in the order of size, so many at a time that their sums fit ``CELLS``, or one."""
    i = 0
    while i < len(some):
        j = i + 1
        while j < len(some) and (j + 1 - i) * (int(size[some[j]]) + extra) <= CELLS:
            j += 1
        yield some[i:j]
        i = j


class LongUnits:
    """Forward sums of long distinct units, scaled by powers of two, and sampling of their paths from the end."""

    def __init__(self, vocab: Vocabulary, text: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.vocab, self.text = vocab, text
        n, reach = int(size.max()), vocab.longest
        by_size = np.argsort(-size, kind="stable")
        self.lane = np.empty(len(size), np.int64)
        self.lane[by_size] = np.arange(len(size))
        start, size = start[by_size], size[by_size]
        padded = np.concatenate([text, np.zeros(n + reach + 4, np.uint8)])
        self.total = total = np.zeros((len(size), n + reach + 4))
        self.shift = shift = np.zeros((len(size), n + 1), np.int64)
        scale = np.zeros(len(size), np.int64)
        total[:, 0] = 1
        for i in range(n):
            m = int(np.searchsorted(-size, -i, "left"))
            if i % 4 == 0:
                top = np.frexp(total[:m, i : i + reach + 1].max(1))[1].astype(np.int64)
                total[:m, i : i + reach + 4] = np.ldexp(total[:m, i : i + reach + 4], -top[:, None])
                scale[:m] += top
            shift[:m, i] = scale[:m]
            lane = np.flatnonzero(total[:m, i] > 0)
            if not len(lane):
                continue
            head = padded[start[lane] + i]
            point = 1 + (head >= 0xC0).astype(np.int64) + (head >= 0xE0) + (head >= 0xF0)
            lone = np.ones(len(lane), bool)
            live, node, k = np.arange(len(lane)), np.zeros(len(lane), np.int32), 0
            while len(live):
                k += 1
                ok = k <= size[lane[live]] - i
                live, node = live[ok], node[ok]
                node = vocab.step(node, padded[start[lane[live]] + i + k - 1])
                live, node = live[node >= 0], node[node >= 0]
                piece = vocab.piece_at[node]
                full = piece >= 0
                at = live[full]
                lone[at[point[at] == k]] = False
                total[lane[at], i + k] += total[lane[at], i] * vocab.weight[piece[full]]
            at = np.flatnonzero(lone)
            total[lane[at], i + point[at]] += total[lane[at], i] * vocab.byte_weight ** point[at]
        done = size - 1
        shift[np.arange(len(size)), size] = shift[np.arange(len(size)), done]

    def sample(self, kind, start, left, origin, seeds, chosen) -> None:
        """As ``Lattice.sample``."""
        keys, goals, piece_at = self.vocab.reverse()
        lane = self.lane[kind]
        while len(start):
            end = start + left
            weight = np.zeros((len(start), self.vocab.longest + 4))
            which = np.full(weight.shape, -1, np.int64)
            live, node, k = np.arange(len(start)), np.zeros(len(start), np.int64), 0
            part = lambda at, k: np.ldexp(self.total[lane[at], left[at] - k], np.clip(self.shift[lane[at], left[at] - k] - self.shift[lane[at], left[at]], -2000, 2000))
            while len(live):
                k += 1
                live, node = live[k <= left[live]], node[k <= left[live]]
                key = node * 256 + self.text[end[live] - k]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                ok = keys[at] == key
                live, node = live[ok], goals[at[ok]]
                piece = piece_at[node]
                full = piece >= 0
                a = live[full]
                weight[a, k - 1] = part(a, k) * self.vocab.weight[piece[full]]
                which[a, k - 1] = piece[full]
            point = np.ones(len(start), np.int64)
            for j in (1, 2, 3):
                at = point == j
                point[at] += (self.text[end[at] - j] & 0xC0) == 0x80
            spell = np.flatnonzero(which[np.arange(len(start)), point - 1] < 0)
            for a in (spell[point[spell] == j] for j in (1, 2, 3, 4)):
                if len(a):
                    j = int(point[a[0]])
                    weight[a, j - 1] = part(a, j) * self.vocab.byte_weight**j
            run = np.cumsum(weight, 1)
            r = mix(seeds ^ ((end - origin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            r = (r >> np.uint64(11)).astype(np.float64) * 2.0**-53 * run[:, -1]
            n = np.minimum((run <= r[:, None]).sum(1), weight.shape[1] - 1)
            n = np.where(weight[np.arange(len(n)), n] > 0, n, weight.argmax(1)) + 1
            piece = which[np.arange(len(n)), n - 1]
            taken = piece >= 0
            chosen[(end - 1)[taken]] = piece[taken]
            for j in (1, 2, 3, 4):
                at = (end - j)[~taken & (n >= j)]
                chosen[at] = self.vocab.byte_ids[self.text[at]]
            left = left - n
            more = left > 0
            start, left, lane, origin, seeds = start[more], left[more], lane[more], origin[more], seeds[more]


def unit_hashes(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the units, a stretch of text at a time."""
    out = np.empty(len(start), np.uint64)
    cuts = np.append(np.searchsorted(start, np.arange(0, len(text), 1 << 18)), len(start))
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            lo, hi = start[a], stop[b - 1]
            sums = prefix_sums(text[lo:hi].astype(np.uint64) + np.uint64(1))
            out[a:b] = span_hash(sums, start[a:b] - lo, stop[a:b] - lo)
    return out


class Lattice:
    """Forward sums of distinct units, and their edges ordered by (unit, end)."""

    def __init__(self, vocab: Vocabulary, text: np.ndarray, start: np.ndarray, stop: np.ndarray):
        size = stop - start
        width = int(size.max()) + 1
        by_size = np.argsort(-size, kind="stable")
        start, size = start[by_size].astype(np.int32), size[by_size].astype(np.int32)
        place = np.empty(len(by_size), np.int64)
        place[by_size] = np.arange(len(by_size))
        padded = np.concatenate([text, np.zeros(width + 1, np.uint8)])
        total = np.zeros((len(start), width))
        total[:, 0] = 1
        edge_key, edge_piece, edge_part = [], [], []

        def add(lane, i, n, piece, weight):
            part = total[lane, i] * weight
            total[lane, i + n] += part
            edge_key.append((lane * width + (i + n)) * 64 + n)  # no two edges have the same: the order is one for all batches
            edge_piece.append(np.broadcast_to(np.asarray(piece, np.int32), lane.shape))
            edge_part.append(part)

        for i in range(width - 1):
            lane = np.arange(int(np.searchsorted(-size, -i, "left")), dtype=np.int32)
            lane = lane[total[lane, i] > 0]
            if not len(lane):
                continue
            head = padded[start[lane] + i]
            point = 1 + (head >= 0xC0).astype(np.int64) + (head >= 0xE0) + (head >= 0xF0)
            lone = np.ones(len(lane), bool)
            live, node = np.arange(len(lane), dtype=np.int32), np.zeros(len(lane), np.int32)
            at_lane, room = start[lane] + i, size[lane] - i
            n = 0
            while len(live):
                n += 1
                ok = n <= room[live]
                if not ok.all():
                    live, node = live[ok], node[ok]
                node = vocab.step(node, padded[at_lane[live] + (n - 1)])
                ok = node >= 0
                live, node = live[ok], node[ok]
                piece = vocab.piece_at[node]
                full = piece >= 0
                if full.any():
                    at, p = live[full], piece[full]
                    lone[at[point[at] == n]] = False
                    add(lane[at], i, n, p, vocab.weight[p])
            for n in (1, 2, 3, 4):
                at = lane[lone & (point == n)]
                if len(at):
                    add(at, i, n, -1, vocab.byte_weight**n)
        key = np.concatenate(edge_key)
        order = np.argsort(key)
        key = key[order]
        self.key, self.size, self.piece = key >> 6, (key & 63).astype(np.int8), np.concatenate(edge_piece)[order]
        share = np.concatenate(edge_part)[order] / total.ravel()[self.key]
        # cumulative shares within a key, made one ascending array: rank of the key + share
        first = np.ones(len(self.key), bool)
        first[1:] = self.key[1:] != self.key[:-1]
        rank = np.cumsum(first) - 1
        run = np.cumsum(share)
        before = (run - share)[first]
        self.upto = rank + (run - before[rank])
        last = np.append(first[1:], True)
        self.upto[last] = rank[last] + 1.0
        self.rank = np.full(len(total) * width, -1, np.int64)
        self.rank[self.key[first]] = rank[first]
        self.first_edge = np.append(np.flatnonzero(first), len(self.key))
        self.width, self.place, self.vocab, self.text = width, place, vocab, text

    def sample(self, kind, start, left, origin, seeds, chosen) -> None:
        """Draw a path for every unit (equal units side by side); ``chosen`` gets each piece at the place of its last byte."""
        base = self.place[kind] * self.width
        while len(start):
            end = start + left
            r = mix(seeds ^ ((end - origin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            r = (r >> np.uint64(11)).astype(np.float64) * 2.0**-53
            rank = self.rank[base + left]
            e = np.searchsorted(self.upto, rank + r, "right")
            e = np.clip(e, self.first_edge[rank], self.first_edge[rank + 1] - 1)
            piece, n = self.piece[e], self.size[e].astype(np.int64)
            spelt = piece < 0
            chosen[(end - 1)[~spelt]] = piece[~spelt]
            if spelt.any():
                for k in (1, 2, 3, 4):
                    at = (end - k)[spelt & (n >= k)]
                    chosen[at] = self.vocab.byte_ids[self.text[at]]
            left = left - n
            live = left > 0
            start, left, base, origin, seeds = start[live], left[live], base[live], origin[live], seeds[live]


def encoder(vocab, key: str, seed: int):
    """Batches of key, text and row_key to batches of key, text and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("text")
            data, offsets = text_buffers(col)
            keys = np.asarray(batch.column("row_key").to_numpy(zero_copy_only=False), np.int64)
            for i, j in slices(offsets, SLICE):
                ids, cuts = vocab.value.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], keys[i:j], seed)
                null = np.asarray(col.slice(i, j - i).is_null().to_numpy(zero_copy_only=False))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                if null.any():
                    lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(i, j - i), col.slice(i, j - i), lists], names=[key, "text", "ids"])
            trim()

    return run


def decoder(vocab):
    """Batches with ids to the same with ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("ids")
            null = np.asarray(col.is_null().to_numpy(zero_copy_only=False))
            lengths = np.asarray(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            ids = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.int32)
            data, cuts = vocab.value.decode(ids, np.concatenate([[0], np.cumsum(lengths)]))
            text = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
            if null.any():
                text = pa.array([None if x else t for x, t in zip(null, text.to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])
            trim()

    return run


def _keyed(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    rows = docs.select(key, "text", F.xxhash64(F.col(key)).alias("row_key"))
    return rows, f"`{key}` {dict(docs.dtypes)[key]}, text string, ids array<int>"


def encode(docs: DataFrame, key: str = "doc_id", model_file: str | None = None, seed: int = SEED, alpha: float = ALPHA, vocab=None) -> DataFrame:
    """key, text and the sampled piece ids of every row."""
    vocab = vocab or docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file or default_model(), alpha))
    rows, schema = _keyed(docs, key)
    return rows.mapInArrow(encoder(vocab, key, seed), schema)


def decode(encoded: DataFrame, model_file: str | None = None, vocab=None) -> DataFrame:
    """The columns of ``encoded`` and the decoded text."""
    vocab = vocab or encoded.sparkSession.sparkContext.broadcast(Vocabulary(model_file or default_model()))
    return encoded.mapInArrow(decoder(vocab), ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded string")


def round_trip(docs: DataFrame, key: str = "doc_id", model_file: str | None = None, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """``decode(encode(docs))`` in one Python worker a task: the vocabulary is held once, not twice."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file or default_model(), alpha))
    forth, back = encoder(vocab, key, seed), decoder(vocab)
    rows, schema = _keyed(docs, key)
    return rows.mapInArrow(lambda batches: back(forth(batches)), schema + ", decoded string")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again; the query keeps digests."""
    both = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )
