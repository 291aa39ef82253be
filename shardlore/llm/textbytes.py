"""Vectorised views of texts as UTF-8 bytes: words, 64-bit hashes, and slices of a batch that fit a cache."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Odd multipliers, and the constants of a 64-bit finaliser.
_PAIR, _LENGTH, _M1, _M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Spans of more bytes are hashed one by one.
LONG = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Of the GNU library, where it is the one in use.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pa.compute.fill_null(col, b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def release() -> None:
    """Gives back to the system what this worker has freed: it waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes; a longer document stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(30))
    h *= U64(_M1)
    h ^= h >> U64(27)
    h *= U64(_M2)
    return h ^ (h >> U64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order. Every step is mixed, so no sum of products can cancel, whatever the text."""
    return mix(a * U64(_PAIR) + b)


def octets(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as an integer; zeros follow the last one."""
    wide = np.zeros(len(data) + 16, np.uint8)
    wide[: len(data)] = data
    return np.ndarray((len(data) + 9,), "<u8", wide.data, 0, (1,))


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words that ASCII white space separates, and each document's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~SPACE[data]
    new = np.zeros(len(data) + 1, bool)
    new[off] = True
    before = np.concatenate(([False], ink[:-1]))
    after = np.concatenate((ink[1:], [False]))
    starts = np.flatnonzero(ink & (~before | new[:-1]))
    ends = np.flatnonzero(ink & (~after | new[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, at_once: int = 1 << 17) -> np.ndarray:
    """A hash of data[s:e] for each s and e, of what stands there alone: 8 bytes at a time, and spans over LONG bytes by a library. Some spans at a time, which lie in ascending order."""
    out = np.empty(len(starts), U64)
    for a in range(0, len(starts), at_once):
        s, e = starts[a : a + at_once], ends[a : a + at_once]
        lo = int(s.min())
        out[a : a + at_once] = _spans(data[lo : int(e.max())], s - lo, e - s, seed)
    return out


def _spans(data: np.ndarray, s: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    by = octets(data)
    # The seed enters before the first mixing too, else spans of up to 8 bytes that clash under one seed clash under all.
    h = mix(mix(by[s] & _MASK[np.minimum(n, 8)] ^ U64(seed)) + n.astype(U64) * U64(_LENGTH) + U64(seed))
    live, at = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(live):
        own, left = s[live] + at, n[live] - at
        h[live] = pair(h[live], by[own] & _MASK[np.minimum(left, 8)])
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[s[i] : s[i] + n[i]].tobytes(), seed)
    return h


def fold(words: np.ndarray, begin: np.ndarray, count: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of count words from each begin on, one after another."""
    h, live, k = mix(count.astype(U64) + U64(seed)), np.flatnonzero(count > 0), 0
    while len(live):
        h[live] = pair(h[live], words[begin[live] + k])
        k += 1
        live = live[count[live] > k]
    return h


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size words from each place on, from hashes of 1, 2, 4 ... words."""
    n, out, at, level, k = max(len(words) - size + 1, 0), None, 0, words, 1
    while True:
        if size & k:
            own = level[at : at + n]
            out, at = own if out is None else pair(out, own), at + k
        if 2 * k > size:
            return out
        level, k = pair(level[: len(level) - k], level[k:]) if len(level) > k else level[:0], 2 * k


def window_hashes(words: np.ndarray, first: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, word index of each window's start, document of each) of all windows of size consecutive words. short: a document of fewer words, but not none, is one window."""
    n = np.diff(first)
    count = np.maximum(n - size + 1, (n > 0).astype(n.dtype) if short else 0)
    doc = np.repeat(np.arange(len(n)), count)
    begin = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
    few = n[doc] < size
    if not few.any():
        return runs(words, size)[begin], begin, doc
    h = np.empty(len(begin), U64)
    h[~few] = runs(words, size)[begin[~few]]
    h[few] = fold(words, begin[few], n[doc[few]])
    return h, begin, doc


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
