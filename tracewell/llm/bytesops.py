"""NumPy building blocks over UTF-8 bytes: Arrow text buffers, words, hashes.

A word is a maximal run of ASCII letters, ASCII digits and bytes from 0x80 on, lower-cased
in A-Z only, which equals the regular expression ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on
the lower-cased text. All functions work on a few megabytes at a time, so a worker's memory
depends on its longest single text, not on the number of rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

IS_WORD = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    IS_WORD[_lo:_hi] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: nothing to trim
    _libc = None

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
WORD_CODE = BYTE_CODE[LOWER]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i (mod 2**64) for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 19)
        for name, base in (("up", BASE), ("down", _INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any substring in constant time (see ``span_hash``)."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def raw_span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial value of codes[start:stop], not finalised (so that spans can be joined)."""
    _, down = powers(len(sums))
    return (sums[stop] - sums[start]) * down[start]


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix(raw_span_hash(sums, start, stop) + (stop - start).astype(np.uint64))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.dtype(np.int64 if wide else np.int32)
    offsets = np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * kind.itemsize).astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with at most ``limit`` bytes together, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = IS_WORD[buf]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(buf)]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    first[cuts] = w[cuts]
    last[:-1] &= ~w[1:]
    inner = cuts[cuts > 0]
    last[inner - 1] = w[inner - 1]
    start = np.flatnonzero(first)
    stop = np.flatnonzero(last) + 1
    return start, stop, owners(start, offsets)


def owners(ascending: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each of some ascending places."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(ascending, offsets)))


def word_hashes(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(WORD_CODE[buf]), start, stop)


#: Odd multipliers that order the words of a shingle.
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, and their rows.

    ``rows`` must be ascending. A row of fewer than n words, but not none, gives one shingle
    of all its words.
    """
    if not len(words):
        return words, rows
    m = len(words) - n + 1
    out_h, out_r = [], []
    if m > 0:
        inside = rows[:m] == rows[n - 1 :]
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h += words[k : k + m] * _PLACE[k]
        out_h.append(mix(h[inside]))
        out_r.append(rows[:m][inside])
    cut = np.flatnonzero(np.diff(rows)) + 1
    starts = np.concatenate([[0], cut])
    sizes = np.diff(np.concatenate([starts, [len(rows)]]))
    for i in np.flatnonzero(sizes < n):
        s, k = starts[i], sizes[i]
        h = (words[s : s + k] * _PLACE[:k]).sum(dtype=np.uint64)
        out_h.append(mix(np.array([h + _U(k)], np.uint64)))
        out_r.append(rows[s : s + 1])
    h, r = np.concatenate(out_h), np.concatenate(out_r)
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def packed(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane: the planes of sorted keys and small numbers compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes | None, kind=np.uint64) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()
