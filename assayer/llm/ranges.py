"""Sums of sorted 48-bit codes, dealt between chunks of documents and even ranges of the code space.

A chunk sends each range its distinct codes in one row (differences of 32 bits
where they fit), a range answers each chunk in one row: per-code work stays in
numpy, and rows grow with the codes sent at most, whatever their skew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def part_of(codes: np.ndarray, n: int) -> np.ndarray:
    """The range of 48-bit codes: n even parts."""
    return ((codes >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cuts(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and ends of the runs of equal values."""
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return at, np.append(at[1:], len(part))[: len(at)]


def pack(codes: np.ndarray) -> bytes:
    step = np.diff(codes, prepend=codes[:1])
    if len(step) and int(step.max()) >= 1 << 32:
        return b"\1" + codes.astype("<u8").tobytes()
    return b"\0" + codes[:1].astype("<u8").tobytes() + step.astype("<u4").tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\1":
        return np.frombuffer(blob, "<u8", offset=1)
    return np.frombuffer(blob, "<u8", 1, 1) + np.cumsum(np.frombuffer(blob, "<u4", offset=9), dtype=np.uint64)


def blobs(group: pa.Table, column: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in group.column(column)]


def sum_by_code(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, the sums of their values, and each entry's place among the distinct."""
    distinct, place = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(place, weights=values, minlength=len(distinct)), place
