"""Numbers for the distinct words of a partition: words are compared as bytes, never by fingerprint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


class WordIds(dict):
    """word -> 0, 1, 2, ... in the order of arrival; looking a new word up numbers it."""

    def __init__(self, words: tuple[bytes, ...] = ()):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.list = list(words)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.list)
        self.list.append(word)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def text_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about `size` bytes, across and within batches; a larger row is a run of its own."""
    held, total = [], 0
    for b in batches:
        start = 0
        each = b.slice(0, 1).nbytes if b.num_rows == 1 else max(1, b.nbytes // max(b.num_rows, 1))
        step = max(1, size // each)
        while start < b.num_rows:
            part = b.slice(start, step)
            start += step
            held.append(part)
            total += part.nbytes
            if total >= size:
                yield _joined(held)
                held, total = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def pairs(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (left, right), right < n, as one number each, how often each occurs, and each entry's place among them."""
    distinct, place, count = np.unique(left * n + right, return_inverse=True, return_counts=True)
    return distinct, count, place
