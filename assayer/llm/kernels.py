"""Vectorised text kernels that work on the buffers of an Arrow string column.

A batch of texts is one byte buffer with offsets; every kernel is a few numpy
passes over that buffer, so the cost a byte is small and no Python string is
made. Batches are cut into blocks of whole texts of about BLOCK bytes to keep
the temporaries in cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, dtype=np.uint64)
LONG_WORD = 256
_LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), _BASE, dtype=np.uint64)
        p[0] = 1
        _powers = np.cumprod(p)
    return _powers


@dataclass
class Texts:
    """Texts first..last of a column: bytes, and where each text starts (n + 1 offsets from 0)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def buffers(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The whole column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    if pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(0, d, o - o[0])


def blocks(texts: Texts, size: int = BLOCK) -> Iterator[Texts]:
    """Cut into runs of whole texts of about size bytes; a longer text is a block of its own."""
    o, i, n = texts.offsets, 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + size, side="right")) - 1)
        yield Texts(texts.first + i, texts.data[o[i] : o[j]], o[i : j + 1] - o[i])
        i = j


def word_bounds(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) and the number of words of each text."""
    d, o = texts.data, texts.offsets
    inside = ~_SPACE[d]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = o[1:-1]
    cut = cut[(cut > 0) & (cut < len(d))]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.diff(np.searchsorted(s, o))


def word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of the lower-cased (A-Z) words in order, and the number of words of each text."""
    s, e, counts = word_bounds(texts)
    return hashes_of(texts, s, e), counts


def hashes_of(texts: Texts, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Fingerprints of the words that word_bounds found: eight bytes at a time through two states that
    each mix in the other, so that no eight bytes undo a difference in both; long words by BLAKE2."""
    length = e - s
    d = np.concatenate([_LOWER[texts.data], np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(d) - 7,), "<u8", d, strides=(1,))
    a = mix(length.astype(np.uint64) * MULT + np.uint64(1))
    b = mix(length.astype(np.uint64) * _BASE + np.uint64(2))
    live, at, left = np.flatnonzero(length <= LONG_WORD), 0, length
    while len(live):
        left = length[live] - at
        x = lanes[s[live] + at] & _LANE[np.minimum(left, 8)]
        u, v = a[live], b[live]
        a[live] = u = mix((u ^ x) * MULT) + v
        b[live] = mix(v + x * _BASE ^ (u << np.uint64(29) | u >> np.uint64(35)))
        live, at = live[left > 8], at + 8
    out = mix(a + (b << np.uint64(32) | b >> np.uint64(32)))
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(d[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def grams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of runs of n words within each text, and how many each text has; a text of
    fewer than n words (but some) has one: its whole sequence."""
    out_counts = np.maximum(counts - n + 1, (counts > 0).astype(counts.dtype))
    total = len(hashes)
    if not total:
        return np.zeros(0, np.uint64), out_counts
    g = np.zeros(total, np.uint64)
    for j in range(min(n, total)):
        g[: total - j] = g[: total - j] * MULT + hashes[j:] if j else hashes
    ends = np.cumsum(counts)
    starts = ends - counts
    left = np.repeat(ends, counts) - np.arange(total)
    keep = left >= n
    short = np.flatnonzero((counts > 0) & (counts < n))
    for i in short:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in hashes[starts[i] : ends[i]]:
                h = h * MULT + x
            g[starts[i]] = h + np.uint64(int(counts[i])) * _BASE
        keep[starts[i]] = True
    return mix(g[keep]), out_counts


def distinct_per_text(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text and their number."""
    if not len(values):
        return values, counts
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[first], np.bincount(d[first], minlength=len(counts))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all runs start, start + 1, ... in one array."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
