"""AVI motion JPEG: texts stored as intra frames, read back through the RIFF index, and cut into shots.

A payload byte is one quantised DCT coefficient of a baseline JPEG frame (4:4:4,
all quantisers 1), so storing is lossless: the coefficient's amplitude bits are
the byte. The Huffman tables hold one 8-bit code, category 8, and every MCU is
a restart interval, which makes an MCU 192 payload bytes at fixed places; both
directions are then array operations. Frames that use other tables are refused
with an error rather than decoded wrongly.

Shots are cut where the difference of neighbouring luma histograms exceeds the
mean of the last differences by a multiple of their spread (adaptive) and a floor.

Defined results: null counts as empty, whose payload is one MCU of blanks; equal
texts give equal bytes and features; any length is stored whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MCU = 192
#: MCUs in a row and rows of MCUs of a frame that is full.
ACROSS, DOWN = 8, 4
FPS = 25
BINS = 16
#: A shot begins where a histogram difference exceeds mean + SPREAD * deviation of the last WINDOW ones, and FLOOR.
WINDOW, SPREAD, FLOOR = 8, 3.0, 0.12

# The zigzag order of baseline JPEG.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _idct_matrix() -> np.ndarray:
    """64 x 64: coefficients in zigzag order to pixels of an 8 x 8 block."""
    k = np.arange(8)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


_IDCT = _idct_matrix()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, where: int) -> bytes:
    """One code of 8 bits, all zero, for category 8 (after no zeros)."""
    return _segment(0xC4, bytes([kind << 4 | where, *[0] * 7, 1, *[0] * 8, 8]))


def _header(across: int, down: int) -> bytes:
    quantisers = _segment(0xDB, bytes([0, *[1] * 64]))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 3) + b"\x01\x11\x00\x02\x11\x00\x03\x11\x00")
    scan = _segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")
    return b"\xff\xd8" + quantisers + frame + _huffman(0, 0) + _huffman(1, 0) + _segment(0xDD, b"\x00\x01") + scan


def _scan(data: np.ndarray) -> bytes:
    """Entropy-coded bytes of one frame: for each MCU 192 times code and amplitude, then a restart marker."""
    n = len(data) // MCU
    out = np.zeros((n, 2 * MCU + 2), np.uint8)
    out[:, 1 : 2 * MCU : 2] = data.reshape(n, MCU)
    out[:, -2] = 0xFF
    out[:, -1] = 0xD0 + np.arange(n) % 8
    if (data == 0xFF).any():
        return b"".join(row[:-2].tobytes().replace(b"\xff", b"\xff\x00") + row[-2:].tobytes() for row in out)[:-2]
    return out.tobytes()[:-2]


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % MCU or (0 if text else MCU))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(data: bytes) -> bytes:
    """An AVI of a payload (a positive multiple of 192 bytes); the last frame is filled up with blanks."""
    mcus = len(data) // MCU
    across, down = min(ACROSS, mcus), min(DOWN, -(-mcus // ACROSS))
    each = across * down * MCU
    flat = np.frombuffer(data + b" " * (-len(data) % each), np.uint8)
    head = _header(across, down)
    frames = [head + _scan(flat[i : i + each]) + b"\xff\xd9" for i in range(0, len(flat), each)]
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, across * 8, down * 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, across * 8, down * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, across * 8, down * 8, 1, 24, b"MJPG", across * down * MCU, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"%d" % len(data)))
    parts, index, at = [], [], 4
    for f in frames:
        parts.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    body = hdrl + info + _chunk(b"LIST", b"movi" + b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


@dataclass
class Video:
    width: int
    height: int
    fps: float
    data: bytes
    histograms: np.ndarray
    mean_luma: np.ndarray


def _riff(buf: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= end:
        size = struct.unpack_from("<I", buf, start + 4)[0]
        yield buf[start : start + 4], start + 8, size
        start += 8 + size + size % 2


def _frame(jpeg: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and the coefficients' bytes of one frame."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, width, height, restart, tables = 2, 0, 0, 0, 0
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if marker == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
        elif marker == 0xC4:
            if body[1:] != bytes([*[0] * 7, 1, *[0] * 8, 8]):
                raise ValueError("Huffman tables other than the single 8-bit code are not decoded")
            tables += 1
        elif marker == 0xDB and set(body[1:]) != {1}:
            raise ValueError("quantisers other than 1 are not decoded")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        at += 2 + size
        if marker == 0xDA:
            break
    if restart != 1 or tables != 2:
        raise ValueError("a frame needs a restart marker after each MCU and two Huffman tables")
    n = (width // 8) * (height // 8)
    scan = jpeg[at:-2]
    if len(scan) != n * (2 * MCU + 2) - 2:
        scan = scan.replace(b"\xff\x00", b"\xff")
        # 0xFF 0x00 is an amplitude's stuffing; the code byte after it stays
    rows = np.frombuffer(scan + b"\xff\xd0", np.uint8).reshape(n, 2 * MCU + 2)
    if rows[:, 0 : 2 * MCU : 2].any():
        raise ValueError("a code that is not in the table")
    return width, height, rows[:, 1 : 2 * MCU : 2]


def read_avi(buf: bytes) -> Video:
    """Frames located by idx1 and decoded: the payload, and luma histograms of the pixels."""
    if buf[:4] != b"RIFF" or buf[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    movi, index, length, fps = 0, [], None, float(FPS)
    for name, at, size in _riff(buf, 12, len(buf)):
        if name == b"LIST" and buf[at : at + 4] == b"movi":
            movi = at
        elif name == b"LIST" and buf[at : at + 4] == b"INFO":
            length = next((int(buf[x : x + s]) for k, x, s in _riff(buf, at + 4, at + size) if k == b"ICMT"), None)
        elif name == b"LIST" and buf[at : at + 4] == b"hdrl":
            fps = next(1e6 / struct.unpack_from("<I", buf, x)[0] for k, x, _ in _riff(buf, at + 4, at + size) if k == b"avih")
        elif name == b"idx1":
            index = list(struct.iter_unpack("<4sIII", buf[at : at + size]))
    coded, width, height = [], 0, 0
    for _, _, offset, size in index:
        start = movi + offset + 8
        width, height, rows = _frame(buf[start : start + size])
        coded.append(rows)
    units = np.stack(coded)
    amplitude = units[:, :, :64].astype(np.float32)
    amplitude[amplitude < 128] -= 255
    pixels = np.clip(amplitude.reshape(-1, 64) @ _IDCT + 128.5, 0, 255).astype(np.uint8).reshape(len(coded), -1)
    cell = pixels // (256 // BINS) + (np.arange(len(coded)) * BINS)[:, None].astype(np.int64)
    histograms = np.bincount(cell.ravel(), minlength=len(coded) * BINS).reshape(-1, BINS)
    return Video(width, height, fps, units.tobytes()[:length], histograms, pixels.mean(axis=1))


def shot_starts(histograms: np.ndarray) -> list[int]:
    h = histograms / histograms.sum(axis=1, keepdims=True)
    change = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    starts, last = [0], 0
    for i, d in enumerate(change):
        seen = change[max(last, i - WINDOW) : i]
        limit = seen.mean() + SPREAD * seen.std() if len(seen) >= 2 else FLOOR
        if d > max(limit, FLOOR):
            starts.append(i + 1)
            last = i + 1
    return starts


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, payload_bytes, media: the AVI of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                raw = [(x or "").encode() for x in part.column(1).to_pylist()]
                data = [payload(x) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(map(len, data), pa.int64()), pa.array(map(write_avi, data), pa.binary())], names=[key, "n_bytes", "payload_bytes", "media"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, media binary")


_CLIP = ("clip", "first_frame", "n_frames", "start_s", "end_s", "mean_luma", "error")


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per shot: key, clip, first_frame, n_frames, start_s, end_s, mean_luma, error. Media that cannot be read give one
    row with nothing but the error; null media give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in range(b.num_rows):
                part = b.slice(one, 1)
                if not part.column(1)[0].is_valid:
                    continue
                try:
                    v = read_avi(part.column(1)[0].as_py())
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.nulls(1, t) for t in (pa.int32(),) * 3 + (pa.float64(),) * 3), pa.array([f"{type(e).__name__}: {e}"])], names=[key, *_CLIP])
                    continue
                starts = shot_starts(v.histograms)
                ends = [*starts[1:], len(v.histograms)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([0] * len(starts))), pa.array(range(len(starts)), pa.int32()), pa.array(starts, pa.int32()), pa.array([y - x for x, y in zip(starts, ends)], pa.int32()),
                     pa.array([x / v.fps for x in starts]), pa.array([x / v.fps for x in ends]), pa.array([float(v.mean_luma[x:y].mean()) for x, y in zip(starts, ends)]), pa.nulls(len(starts), pa.string())],
                    names=[key, *_CLIP],
                )

    return media.select(key, column).mapInArrow(run, f"`{key}` {media.schema[key].dataType.simpleString()}, clip int, first_frame int, n_frames int, start_s double, end_s double, mean_luma double, error string")


def _feature(v: Video) -> str:
    starts = shot_starts(v.histograms)
    total = v.histograms.sum(axis=0)
    return f"{v.width}x{v.height};frames={len(v.histograms)};shots={len(starts)};cuts={','.join(map(str, starts[1:]))};luma={'-'.join(map(str, total.tolist()))}"


def media_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What was stored and read back of each text, in one pass so that the media never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = []
            for x in b.column(1).to_pylist():
                raw = (x or "").encode()
                media = write_avi(payload(raw))
                v = read_avi(media)
                rows.append((len(raw), len(v.data), sha(v.data), zlib.crc32(v.data[-16:]), len(media), sha(media), _feature(v)))
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
