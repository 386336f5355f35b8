"""Repeated passages by prefix-free parsing, removed wherever a smaller id has them.

A rolling hash of TRIGGER bytes marks triggers: in each window of `length` bytes
the smallest hash, leftmost, is the window's trigger, which depends on the
window's bytes alone. Neighbouring windows with one trigger make a phrase: the
bytes those windows cover. Every window lies in exactly one phrase of each text
that holds it, always at the same distance from an equal trigger, so only
phrases with equal triggers need to be compared (the parse), and equal phrases
need to be compared once (the dictionary). The suffixes of the dictionary's
phrases are sorted by their first `length` bytes (a suffix array as deep as the
question asks); suffixes that are equal there are one passage, and the parse
tells the smallest document that has it.

Work is dealt by chunks of documents and by ranges of trigger hashes:
  1. chunks send their distinct trigger hashes, ranges answer which occur in
     more than one document;
  2. chunks send the distinct phrases at those triggers, each with its smallest
     document; ranges sort suffixes and answer, for each phrase, which of its
     windows occur in a smaller document still;
  3. chunks mark and remove bytes.
A passage in very many documents is one phrase a chunk where its context is
the same. Phrases at its edges hold bytes of each document's own, so a trigger
with more than HOT phrases (each counted once a chunk) is dealt by windows instead: a chunk sends each
distinct window of those phrases once, with its smallest document, to a range
by the hash of its bytes. So no range grows with a passage's copies.

Defined results: null counts as empty; texts of fewer than `length` bytes keep
all; rows with one id are one document, whose own repeats stay; a null id is
larger than all others; an empty table gives an empty result; other columns are
passed on where asked for and may have any name not starting with "_".
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import kernels as K
from assayer.llm.tables import discard, pieces, refuse_clashes, volume, written

LENGTH = 50
TRIGGER = 16
CHUNK_BYTES = 6 << 20
HOT = 1 << 12
_SLICE = 1 << 19
_PHRASES = 1 << 14
_PLACE = np.uint64((1 << 20) - 1)
_LAST = np.iinfo(np.int64).max


@dataclass
class Phrases:
    """A chunk's phrases in order of place: first byte, number of windows, trigger's place and hash, document."""

    start: np.ndarray
    windows: np.ndarray
    place: np.ndarray
    trigger: np.ndarray
    doc: np.ndarray


def _rolling(d: np.ndarray) -> np.ndarray:
    h, power = d.astype(np.uint64) + np.uint64(1), K.powers(2)[1]
    k = 1
    with np.errstate(over="ignore"):
        while k < TRIGGER:
            h = h[:-k] * power + h[k:]
            power, k = power * power, 2 * k
    return K.mix(h)


def phrases(texts: K.Texts, docs: np.ndarray, length: int = LENGTH) -> Phrases:
    """Parse texts (with their documents' ids) into phrases."""
    d, o = texts.data, texts.offsets
    span, n = length - TRIGGER + 1, len(texts.data)
    parts: list[tuple[np.ndarray, ...]] = []
    for x in range(0, max(0, n - length + 1), _SLICE):
        y = min(n, x + _SLICE + length - 1)
        h = _rolling(d[x:y])
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while 2 * k <= span:
            key, k = np.minimum(key[:-k], key[k:]), 2 * k
        if k < span:
            key = np.minimum(key[: len(key) - (span - k)], key[span - k :])
        place = (key & _PLACE).astype(np.int64)
        first, last = np.searchsorted(o, x, side="right") - 1, np.searchsorted(o, x + len(place), side="left")
        ends = o[first + 1 : last + 1]
        text = np.repeat(np.arange(first, first + len(ends)), np.diff(np.minimum(np.concatenate([[x], ends]), x + len(place))))
        inside = o[text + 1] - np.arange(x, x + len(place)) >= length
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(place)))
        at, size = at[inside[at]], size[inside[at]]
        parts.append((at + x, size, place[at] + x, h[place[at]], docs[text[at]]))
    if not parts:
        e = np.zeros(0, np.int64)
        return Phrases(e, e, e, e.astype(np.uint64), e)
    return Phrases(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _chunk(group: pa.Table, key: str) -> tuple[pa.Table, K.Texts, np.ndarray]:
    """The group's rows in an order that every pass repeats."""
    group = group.sort_by([(key, "ascending"), ("_text", "ascending")])
    ids = group.column(key).cast(pa.int64()).fill_null(_LAST).to_numpy()
    return group, K.buffers(group.column("_text")), ids


def _coded(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16)


@lru_cache(4)
def _bounds(n: int, span: int) -> np.ndarray:
    """The n - 1 hashes that cut the phrases' triggers into n even parts.

    A trigger is the smallest of span hashes, so small ones are far more frequent: a place with hash x (of 0 to 1) is
    the trigger of some window with probability (1-x)^(span-1) * (1 + (span-1) x). This is the inverse of its integral.
    """
    x = np.linspace(0, 1, (1 << 16) + 1) ** 2
    power = np.ones_like(x)
    for _ in range(span):
        power = power * (1 - x)
    below = ((span + 1) * (1 - power) + (span - 1) * (1 - power * (1 + span * x))) / (2 * span)
    return np.minimum(np.interp(np.arange(1, n) / n, below, x) * 2.0**64, np.nextafter(2.0**64, 0)).astype(np.uint64)


def _ranges(h: np.ndarray, n: int, length: int) -> np.ndarray:
    """The range of each trigger: n even parts of their distribution."""
    return np.searchsorted(_bounds(n, length - TRIGGER + 1), h, side="right")


def _distinct_triggers(p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct coded triggers and whether each occurs in more than one document here."""
    code = _coded(p.trigger)
    order = np.argsort(code, kind="stable")
    c, d = code[order], p.doc[order]
    at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    many = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at) if len(c) else np.zeros(0, bool)
    return c[at], many


def _deltas(codes: np.ndarray) -> bytes:
    step = np.diff(codes, prepend=codes[:1])
    if len(step) and int(step.max()) >= 1 << 32:
        return b"\1" + codes.astype("<u8").tobytes()
    return b"\0" + codes[:1].astype("<u8").tobytes() + step.astype("<u4").tobytes()


def _undeltas(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\1":
        return np.frombuffer(blob, "<u8", offset=1)
    return np.frombuffer(blob, "<u8", 1, 1) + np.cumsum(np.frombuffer(blob, "<u4", offset=9), dtype=np.uint64)


def _send_triggers(key: str, n: int, length: int):
    def run(group: pa.Table) -> pa.Table:
        chunk = group.column("_chunk")[0].as_py()
        _, texts, ids = _chunk(group, key)
        p = phrases(texts, ids, length)
        codes, many = _distinct_triggers(p)
        several = np.flatnonzero(_in_several(p))
        order, new = _same_phrase_order(texts, p, several, length)
        times = np.maximum(1, np.bincount(np.searchsorted(codes, _coded(p.trigger[several[order][new]])), minlength=len(codes)))
        part = _ranges(codes << np.uint64(16), n, length)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(codes) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(codes))[: len(at)]
        return pa.table({
            "_range": pa.array(part[at], pa.int64()), "_chunk": pa.array([chunk] * len(at), pa.int64()),
            "codes": pa.array([_deltas(codes[x:y]) for x, y in zip(at, ends, strict=True)], pa.binary()),
            "many": pa.array([np.packbits(many[x:y]).tobytes() for x, y in zip(at, ends, strict=True)], pa.binary()),
            "times": pa.array([np.minimum(times[x:y], (1 << 16) - 1).astype("<u2").tobytes() for x, y in zip(at, ends, strict=True)], pa.binary()),
        })

    return run


def _answer_triggers(group: pa.Table) -> pa.Table:
    codes = [_undeltas(x.as_py()) for x in group.column("codes")]
    many = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(c)) for x, c in zip(group.column("many"), codes, strict=True)]) > 0
    flat = np.concatenate(codes)
    order = np.argsort(flat, kind="stable")
    c = flat[order]
    same = c[1:] == c[:-1]
    repeated = many[order]
    repeated[1:] |= same
    repeated[:-1] |= same
    # A trigger that is in several documents of one chunk only is answered there as well.
    out = np.zeros(len(flat), bool)
    out[order] = repeated
    times = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in group.column("times")]).astype(np.int64)[order]
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    hot = np.zeros(len(flat), bool)
    hot[order] = np.repeat(np.add.reduceat(times, head) > HOT, np.diff(np.append(head, len(c)))) & repeated
    cuts = np.cumsum([0, *map(len, codes)])
    return pa.table({
        "_chunk": group.column("_chunk"), "_range": group.column("_range"),
        "repeated": pa.array([np.packbits(out[x:y]).tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary()),
        "hot": pa.array([flat[x:y][hot[x:y]].astype("<u8").tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary()),
    })


def _same_phrase_order(texts: K.Texts, p: Phrases, some: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the phrases in some that puts equal ones (trigger, place in it, bytes) together, smallest document
    first, and which of them (in that order) differ from the one before."""
    finger = np.zeros(len(some), np.uint64)
    for x in range(0, len(some), _PHRASES):
        q = some[x : x + _PHRASES]
        size = p.windows[q] + length - 1
        at = np.cumsum(size) - size
        k = np.arange(int(size.sum())) - np.repeat(at, size)
        v = (texts.data[K.ranges(p.start[q], size)].astype(np.uint64) + np.uint64(1)) * K.powers(2 * length)[k]
        finger[x : x + _PHRASES] = K.mix(np.add.reduceat(v, at) + (p.place[q] - p.start[q]).astype(np.uint64) * K.MULT + size.astype(np.uint64))
    order = np.lexsort((some, p.doc[some], finger, p.trigger[some]))
    s = some[order]
    new = np.ones(len(s), bool)
    if len(s) > 1:
        f, t = finger[order], p.trigger[s]
        new[1:] = (f[1:] != f[:-1]) | (t[1:] != t[:-1])
        pairs = np.flatnonzero(~new)
        for x in range(0, len(pairs), _PHRASES):
            pair = pairs[x : x + _PHRASES]
            n = p.windows[s[pair]] + length - 1
            if (texts.data[K.ranges(p.start[s[pair]], n)] != texts.data[K.ranges(p.start[s[pair - 1]], n)]).any():
                raise ArithmeticError("two phrases have one fingerprint")  # 1 in 2**64 for each pair of one trigger
    return order, new


def _hot_codes(answers: pa.Table) -> np.ndarray:
    """The coded triggers that are dealt by windows."""
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_py(), "<u8") for x in answers.column("hot") if x.is_valid)]))


def _hot_windows(texts: K.Texts, p: Phrases, hot: np.ndarray, length: int) -> tuple[Phrases, np.ndarray, np.ndarray]:
    """The windows at hot triggers as phrases of one window, with hashes of their bytes for triggers; their order that
    puts equal ones together, smallest document first; and which of them (in that order) differ from the one before."""
    some = np.flatnonzero(np.isin(_coded(p.trigger), hot)) if len(hot) else np.zeros(0, np.int64)
    n = p.windows[some]
    start, ones = K.ranges(p.start[some], n), np.ones(int(n.sum()), np.int64)
    h = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length if len(start) else 0):
            h = (h + texts.data[start + k].astype(np.uint64) + np.uint64(1)) * K.MULT
    w = Phrases(start, ones, start, K.mix(h), np.repeat(p.doc[some], n))
    return w, *_same_phrase_order(texts, w, np.arange(len(start)), length)


def _send_phrases(key: str, n: int, length: int):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = group.column("_chunk")[0].as_py() if group.num_rows else -1
        _, texts, ids = _chunk(group, key)
        p = phrases(texts, ids, length)
        codes, _ = _distinct_triggers(p)
        answers = answers.sort_by("_range")
        part = _ranges(codes << np.uint64(16), n, length)
        counts = np.bincount(part, minlength=n)[answers.column("_range").to_numpy()] if len(codes) else []
        bits = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=int(c)) for x, c in zip(answers.column("repeated"), counts, strict=True)]
        repeated = np.concatenate(bits) > 0 if bits else np.zeros(len(codes), bool)
        some = np.flatnonzero(repeated[np.searchsorted(codes, _coded(p.trigger))]) if len(codes) else np.zeros(0, np.int64)
        hot = _hot_codes(answers)
        some = some[~np.isin(_coded(p.trigger[some]), hot)]
        order, new = _same_phrase_order(texts, p, some, length)
        one = some[order][new]
        w, order, new = _hot_windows(texts, p, hot, length)
        single = order[new]
        even = np.linspace(0, 2.0**64, n + 1)[1:-1].astype(np.uint64)
        rows = []
        # A window's ordinal is its place, after those of the phrases.
        for of, one, part, first in ((p, one, _ranges(p.trigger[one], n, length), np.arange(len(p.start))), (w, single, np.searchsorted(even, w.trigger[single], side="right"), len(p.start) + w.start)):
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(one) else np.zeros(0, np.int64)
            for x, y in zip(at, np.append(at[1:], len(one))[: len(at)], strict=True):
                q = one[x:y]
                size = of.windows[q] + length - 1
                shape = np.column_stack([of.windows[q], of.place[q] - of.start[q]]).astype("u1")
                rows.append((int(part[x]), chunk, first[q].astype("<u4").tobytes(), of.trigger[q].astype("<u8").tobytes(), of.doc[q].astype("<i8").tobytes(), shape.tobytes(), texts.data[K.ranges(of.start[q], size)].tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_range", "_chunk", "ordinal", "trigger", "doc", "shape", "bytes"])

    return run


def _answer_phrases(length: int):
    words = -(-length // 8)

    def run(group: pa.Table) -> pa.Table:
        blob = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in group.column(c)]
        ordinals = blob("ordinal", "<u4")
        chunk = np.repeat(group.column("_chunk").to_numpy(), [len(x) for x in ordinals])
        ordinal, trigger, doc = np.concatenate(ordinals), np.concatenate(blob("trigger", "<u8")), np.concatenate(blob("doc", "<i8"))
        shape = np.concatenate(blob("shape", "u1")).reshape(-1, 2).astype(np.int64)
        flat = np.concatenate(blob("bytes", "u1"))
        windows, size = shape[:, 0], shape[:, 0] + length - 1
        start = np.cumsum(size) - size
        # The dictionary: equal phrases of all chunks once, with the smallest document.
        p = Phrases(start, windows, start + shape[:, 1], trigger, doc)
        order, new = _same_phrase_order(K.Texts(0, flat, np.array([0, len(flat)])), p, np.arange(len(doc)), length)
        entry = np.empty(len(doc), np.int64)
        entry[order] = np.cumsum(new) - 1
        first = order[new]
        least = doc[first]
        # Suffixes of the phrases whose trigger more than one phrase has, in order of their first bytes.
        t = trigger[first]
        shared = np.zeros(len(first), bool)
        shared[1:] |= t[1:] == t[:-1]
        shared[:-1] |= t[1:] == t[:-1]
        some = np.flatnonzero(shared)
        mask = np.zeros(len(first), np.uint64)
        if len(some):
            owner = np.repeat(some, windows[first[some]])
            shift = K.ranges(np.zeros(len(some), np.int64), windows[first[some]])
            at = start[first[owner]] + shift
            view = np.lib.stride_tricks.sliding_window_view(np.concatenate([flat, np.zeros(8, np.uint8)]), 8)
            columns = [np.ascontiguousarray(view[at + min(8 * j, length - 8)]).view(">u8").ravel() for j in range(words)]
            suffixes = np.lexsort((least[owner], *columns[::-1]))
            equal = np.ones(len(suffixes) - 1, bool)
            for c in columns:
                equal &= c[suffixes[1:]] == c[suffixes[:-1]]
            head = np.flatnonzero(np.concatenate([[True], ~equal]))
            smallest = np.repeat(least[owner[suffixes[head]]], np.diff(np.append(head, len(suffixes))))
            hit = smallest < least[owner[suffixes]]
            np.bitwise_or.at(mask, owner[suffixes[hit]], np.uint64(1) << shift[suffixes[hit]].astype(np.uint64))
        whole = np.where(windows[first] >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(windows[first], 63).astype(np.uint64)) - np.uint64(1))
        answer = np.where(least[entry] < doc, whole[entry], mask[entry])
        hit = np.flatnonzero(answer)
        hit = hit[np.argsort(chunk[hit], kind="stable")]
        c = chunk[hit]
        at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(c))[: len(at)]
        cut = lambda v, kind: pa.array([v[hit[x:y]].astype(kind).tobytes() for x, y in zip(at, ends, strict=True)], pa.binary())
        return pa.table({"_chunk": pa.array(c[at], pa.int64()), "ordinal": cut(ordinal, "<u4"), "windows": cut(answer, "<u8")})

    return run


def _covered(texts: K.Texts, ids: np.ndarray, answers: pa.Table, length: int) -> np.ndarray:
    """Which bytes of the chunk lie in a window that a smaller document has."""
    p = phrases(texts, ids, length)
    flag = np.zeros(len(texts.data) + 1, np.int8)
    # Phrases that the chunk has in a smaller document itself: all their windows.
    order, new = _same_phrase_order(texts, p, np.flatnonzero(_in_several(p)), length)
    s = np.flatnonzero(_in_several(p))[order]
    least = p.doc[s][np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))] if len(s) else s
    later = s[p.doc[s] > least]
    flag[K.ranges(p.start[later], p.windows[later])] = 1
    # The answers are for the chunk's smallest document with the phrase.
    for o, w in zip(answers.column("ordinal"), answers.column("windows"), strict=True):
        if not o.is_valid:
            continue
        at, bits = np.frombuffer(o.as_py(), "<u4").astype(np.int64), np.frombuffer(w.as_py(), "<u8")
        single = at >= len(p.start)
        flag[at[single] - len(p.start)] = 1
        at, bits = at[~single], bits[~single]
        n = p.windows[at]
        shift = K.ranges(np.zeros(len(at), np.int64), n)
        hit = np.repeat(bits, n) >> shift.astype(np.uint64) & np.uint64(1)
        flag[(np.repeat(p.start[at], n) + shift)[hit > 0]] = 1
        # The same document may have the phrase again, with the same answer.
    again = s[(p.doc[s] == least) & ~new] if len(s) else s
    if len(again):
        head = s[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))][(p.doc[s] == least) & ~new]
        flag[K.ranges(p.start[again], p.windows[again])] |= flag[K.ranges(p.start[head], p.windows[head])]
    # The windows at hot triggers were answered where the chunk has each first.
    w, order, new = _hot_windows(texts, p, _hot_codes(answers), length)
    if len(order):
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        flag[w.start[order]] |= flag[w.start[head]] | (w.doc[order] > w.doc[head])
    depth = np.cumsum(flag[:-1], dtype=np.int32)
    depth[length:] -= depth[:-length].copy()
    return depth > 0


def _in_several(p: Phrases) -> np.ndarray:
    """Phrases whose trigger occurs more than once in the chunk."""
    order = np.argsort(p.trigger, kind="stable")
    t = p.trigger[order]
    out = np.zeros(len(t), bool)
    if len(t) > 1:
        same = t[1:] == t[:-1]
        both = np.zeros(len(t), bool)
        both[1:] |= same
        both[:-1] |= same
        out[order] = both
    return out


def _remove(key: str, length: int, keep: tuple[str, ...], names: list[str]):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        group, texts, ids = _chunk(group, key)
        gone = _covered(texts, ids, answers, length)
        o = texts.offsets
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        starts = o[:-1][o[:-1] < len(gone)]
        rise[starts] = gone[starts]
        count = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[o])
        kept = [texts.data[x:y][~gone[x:y]].tobytes() for x, y in zip(o, o[1:], strict=False)]
        made = {
            "n_bytes": np.diff(o), "n_removed": count(gone), "n_spans": count(rise),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()) if "kept_sha256" in names else None,
            "kept_text": pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if "kept_text" in names else None,
        }
        return pa.table({c: group.column(c) if c in (key, *keep) else made[c] for c in names})

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep: tuple[str, ...] = (), kept_text: bool = False) -> DataFrame:
    """key, the columns in keep, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 or, if asked for,
    kept_text (a character of which a byte was removed is left out whole). keep with a name of the result, _text or _chunk raises ValueError."""
    refuse_clashes(keep, key, "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256", "_text", "_chunk")
    if not TRIGGER < length <= TRIGGER + 63:
        raise ValueError(f"length must be {TRIGGER + 1} to {TRIGGER + 63}")
    _, total = volume(docs, text)
    n = pieces(total, CHUNK_BYTES)
    chunk = F.pmod(F.xxhash64(F.col(key)), F.lit(n)).alias("_chunk")
    plain = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"), chunk)
    sent = plain.groupBy("_chunk").applyInArrow(_send_triggers(key, n, length), "_range long, _chunk long, codes binary, many binary, times binary")
    repeated = written(sent.groupBy("_range").applyInArrow(_answer_triggers, "_chunk long, _range long, repeated binary, hot binary"), "repeats-triggers")
    hot = written(repeated.where(F.octet_length("hot") > 0).select("_chunk", F.lit(None).cast("binary").alias("ordinal"), F.lit(None).cast("binary").alias("windows"), "hot"), "repeats-hot")
    found = plain.groupBy("_chunk").cogroup(repeated.groupBy("_chunk")).applyInArrow(_send_phrases(key, n, length), "_range long, _chunk long, ordinal binary, trigger binary, doc binary, shape binary, bytes binary")
    answers = written(found.groupBy("_range").applyInArrow(_answer_phrases(length), "_chunk long, ordinal binary, windows binary"), "repeats-windows")
    discard(repeated)
    answers = answers.withColumn("hot", F.lit(None).cast("binary")).unionAll(hot)
    source = docs.select(key, *keep, F.coalesce(F.col(text), F.lit("")).alias("_text"), chunk)
    names = [key, *keep, "n_bytes", "n_removed", "n_spans", "kept_text" if kept_text else "kept_sha256"]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep)] + ["n_bytes long", "n_removed long", "n_spans long", f"{names[-1]} string"]
    return source.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(_remove(key, length, keep, names), ", ".join(fields))
