"""Packing: windows filled with lexical neighbours found by a sharded BM25 index.

Documents are tokenised once into a written table, from which the document
frequency of every token id is counted (a vector as long as the vocabulary).
Documents are dealt into neighbourhoods of about NEAR_BYTES of ids by their
lexical content: first by the common id that a document has most often, which
parts languages and styles, then by its signs, the two ids that weighted minimum
hashing picks from it (rare ids more often), so two documents share a sign with
the probability of their idf-weighted similarity, and those that do lie
together. A first sign with more than a neighbourhood's ids is parted by the
second, and a pair of signs by a hash of the document's id. What is counted for
that on the driver is at most 2 * IDS rows.

A neighbourhood's inverted index, with BM25 weights under the statistics of the
whole corpus, is cut into shards of SHARD_BYTES; all terms of a seed document
are looked up in every shard and the best unused documents are merged. They
fill the seed's window greedily, best first; the one that no longer fits is cut
and its rest seeds the next window. What the last window of a neighbourhood
leaves is cut at powers of two. So no sequence has padding. A seed does not see
the documents of other neighbourhoods; the README has the measured share of a
seed's true neighbours that it sees.

Defined results: null counts as empty and is one end token; longer documents
run over several windows; equal scores go by number; repeated ids are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import kernels as K
from assayer.llm.bpe import packed_ids, vocabulary
from assayer.llm.tables import written

SHARD_BYTES = 8 << 20
NEAR_BYTES = 4 << 20
#: Pairs of signs and signs that the driver counts: one for each possible id.
IDS, COMMON = 1 << 16, 64
K1, B = 1.2, 0.75
END = 2


def tokenised(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """key, ids (little-endian uint16 with the end token), n."""
    vocab = vocabulary(docs.sparkSession, path)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = vocab.value.chunks()
        for b in batches:
            at = 0
            for ids, counts in packed_ids(cache, K.buffers(b.column(1))):
                flat = np.full(len(ids) + len(counts), end, "<u2")
                ends = np.cumsum(counts)
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                cuts = pa.array(2 * np.concatenate([[0], ends + np.arange(1, len(counts) + 1)]), pa.int32())
                packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, cuts.buffers()[1], pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(counts)), packed, pa.array(counts + 1, pa.int64())], names=[key, "ids", "n"])
                at += len(counts)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary, n long")


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of packed ids, and how many each row has."""
    texts = K.buffers(ids)
    return texts.data.view("<u2").astype(np.int64), np.diff(texts.offsets) // 2


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """In how many documents each id occurs: at most 65,536 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for b in batches:
            flat, counts = _flat(b.column(0))
            pair = np.sort(np.repeat(np.arange(len(counts)), counts) << 16 | flat)
            df += np.bincount(pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]] & 0xFFFF, minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["term", "n"])

    rows = tokens.select("ids").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << 16)
    out[rows["term"].to_numpy(np.int64)] = rows["n"]
    return out


def shard_index(ids: list[np.ndarray], idf: np.ndarray, mean_length: float) -> dict[str, np.ndarray]:
    """Postings by term (docs, weights, and where each term's start) and the terms of each document (terms, cuts)."""
    n, length = len(ids), np.array([len(x) for x in ids], np.int64)
    key, tf = np.unique(np.concatenate(ids).astype(np.int64) * n + np.repeat(np.arange(n), length), return_counts=True)
    term, doc = key // n, (key % n).astype(np.int32)
    tf = tf.astype(np.float32)
    weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean_length))).astype(np.float32)
    order = np.argsort(doc, kind="stable")
    return {
        "lengths": length.astype("<i4"), "docs": doc, "weights": weight, "starts": np.searchsorted(term, np.arange((1 << 16) + 1)).astype("<i4"),
        "terms": term[order].astype("<u2"), "cuts": np.searchsorted(doc[order], np.arange(n + 1)).astype("<i4"),
    }


class Searcher:
    """The unused documents of one shard; terms that many of them have are kept as whole rows."""

    def __init__(self, lengths: np.ndarray, docs: np.ndarray, weights: np.ndarray, starts: np.ndarray, unused: np.ndarray):
        self.at = np.flatnonzero(unused)
        self.lengths, n = lengths[self.at].astype(np.int64), len(self.at)
        place = np.cumsum(unused) - 1
        some = unused[docs]
        self.start = np.concatenate([[0], np.cumsum(some)])[starts]
        self.doc, self.weight = place[docs[some]], weights[some]
        often = np.flatnonzero(np.diff(self.start) > n // 16)
        self.row = np.full(IDS, -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), n), np.float32)
        for i, t in enumerate(often.tolist()):
            self.rows[i, self.doc[self.start[t] : self.start[t + 1]]] = self.weight[self.start[t] : self.start[t + 1]]

    def best(self, terms: np.ndarray, need: int, unused: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores), best first, of as many (still unused) documents that share a term as have `need` tokens together."""
        row = self.row[terms]
        rare = terms[row < 0]
        spot = K.ranges(self.start[rare], self.start[rare + 1] - self.start[rare])
        score = np.bincount(self.doc[spot], self.weight[spot], len(self.at)).astype(np.float32)
        for i in row[row >= 0].tolist():
            score += self.rows[i]
        if unused is not None:
            score[~unused[self.at]] = 0
        some, k = np.flatnonzero(score), 64
        while k < len(some):
            least = np.partition(score[some], len(some) - k)[len(some) - k]
            top = some[score[some] >= least]
            if int(self.lengths[top].sum()) >= need:
                some = top
                break
            k *= 4
        some = some[np.lexsort((some, -score[some]))]
        some = some[: np.searchsorted(np.cumsum(self.lengths[some]), need) + 1]
        return self.at[some], score[some]


def pack_neighbourhood(ids: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every sequence but the last is full."""
    n, length = len(ids), np.array([len(x) for x in ids], np.int64)
    base = np.unique(np.concatenate([[0], np.searchsorted(np.cumsum(2 * length), np.arange(SHARD_BYTES, int(2 * length.sum()), SHARD_BYTES)), [n]]))
    shards = [shard_index(ids[x:y], idf, mean_length) for x, y in zip(base, base[1:], strict=False)]
    unused, done = np.ones(n, bool), np.zeros(n, np.int64)
    search: list[tuple[int, Searcher]] = []
    kept = 0
    pieces, sequence, room, following, seed = [], 0, window, 0, -1

    def put(d: int) -> None:
        """Put the whole document; what a window cannot hold opens the next."""
        nonlocal sequence, room
        unused[d] = False
        while done[d] < length[d]:
            size = min(room, int(length[d] - done[d]))
            pieces.append((d, int(done[d]), size, sequence, window - room))
            done[d] += size
            room -= size
            if not room:
                sequence, room = sequence + 1, window

    while True:
        if seed < 0:
            while following < n and not unused[following]:
                following += 1
            if following == n:
                return pieces
            seed = following
            put(seed)
            if room == window:
                seed = -1
                continue
        left = int(unused.sum())
        if not search or left < kept // 2:
            # What is used is left out of the index each time half of it is.
            search, kept = [(x, Searcher(*(s[c] for c in ("lengths", "docs", "weights", "starts")), unused[x:y])) for x, y, s in zip(base, base[1:], shards, strict=False)], left
        shard = int(np.searchsorted(base, seed, side="right")) - 1
        s, d = shards[shard], seed - base[shard]
        found = [(x + at, score) for x, q in search for at, score in [q.best(s["terms"][s["cuts"][d] : s["cuts"][d + 1]].astype(np.int64), room, unused[x : x + len(unused)])]]
        number, score = (np.concatenate(c) for c in zip(*found, strict=True))
        seed, at = -1, sequence
        for d in number[np.lexsort((number, -score))].tolist():
            put(d)
            if sequence > at:
                seed = d if room < window else -1
                break


def at_powers_of_two(pieces: list[tuple[int, int, int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """Cut an unfilled last sequence into sequences whose lengths are powers of two."""
    if not pieces:
        return pieces
    last = pieces[-1][3]
    tail = [p for p in pieces if p[3] == last]
    total = sum(p[2] for p in tail)
    if total == window:
        return pieces
    out, sequence, at, size = [p for p in pieces if p[3] < last], last, 0, 1 << (total.bit_length() - 1)
    left = total
    for d, start, length, _, _ in tail:
        while length:
            k = min(length, size - at)
            out.append((d, start, k, sequence, at))
            start, length, at, left = start + k, length - k, at + k, left - k
            if at == size and left:
                sequence, at, size = sequence + 1, 0, 1 << (left.bit_length() - 1)
    return out


def sign_tables(idf: np.ndarray, df: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(2, IDS): for each of the two signs the order in which ids are preferred, an exponential race with idf as the rate; and
    for the COMMON commonest ids that at most half of all documents have their number, COMMON for all others."""
    race = np.random.default_rng(20).exponential(size=(2, len(idf))) / np.maximum(idf, 1e-12)
    kind = np.full(len(idf), COMMON)
    often = np.argsort(-np.where(2 * df <= n, df, 0), kind="stable")[:COMMON]
    kind[often] = np.arange(COMMON)
    return np.argsort(np.argsort(race, axis=1, kind="stable"), axis=1), kind


def _signs(ids: pa.Array, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first, second) sign of each row: which common id it has most often with the first sign, folded into IDS values; the second sign."""
    ranks, kind = tables
    flat, counts = _flat(ids)
    starts = np.cumsum(counts) - counts
    if not len(counts):
        return starts, starts
    a, b = (np.minimum.reduceat(r[flat], starts) for r in ranks)  # every row has an id, the end
    often = np.bincount(np.repeat(np.arange(len(counts)), counts) * (COMMON + 1) + kind[flat], minlength=len(counts) * (COMMON + 1)).reshape(len(counts), -1)[:, :COMMON].argmax(axis=1)
    return often * (IDS // COMMON) + a % (IDS // COMMON), b


def dealt(tokens: DataFrame, tables: tuple[np.ndarray, np.ndarray], key: str, total: int) -> DataFrame:
    """key, ids, _hash, _near: the neighbourhood of each document of a table that tokenised() made."""
    context, each = tokens.sparkSession.sparkContext, max(1, NEAR_BYTES // 2)
    signs = context.broadcast(tables)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = _signs(b.column(0), signs.value)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cell, _flat(b.column(0))[1])], names=["a", "b", "n"])

    cells = written(tokens.select("ids").mapInArrow(sign, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "packing-signs")
    large = F.col("n") > max(each, total // IDS)
    hot = cells.where(large).select("a", "b", "n")
    rest = cells.where(~large).groupBy("a").agg(F.lit(-1).cast("long").alias("b"), F.sum("n").alias("n"))
    rows = np.array(sorted(map(tuple, hot.unionByName(rest).collect())), np.int64).reshape(-1, 3)
    code, size = rows[:, 0] << 17 | rows[:, 1] + 1, rows[:, 2]
    sent = context.broadcast((code, np.cumsum(size) - size, size))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, start, size = sent.value
        for b in batches:
            a, c = _signs(b.column(1), signs.value)
            at = np.minimum(np.searchsorted(code, a << 17 | c + 1), len(code) - 1)
            alone = code[at] == a << 17 | c + 1
            at = np.where(alone, at, np.searchsorted(code, a << 17))
            share = np.where(alone, K.mix(b.column(2).to_numpy().astype(np.uint64) + np.uint64(5)), K.mix(c.astype(np.uint64) * K.MULT)) / 2.0**64
            near = ((start[at] + share * size[at]) // each).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], names=[key, "ids", "_hash", "_near"])

    half = F.shiftrightunsigned(F.xxhash64(F.col(key), "ids"), 1)
    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(key, "ids", half.alias("_hash")).mapInArrow(deal, f"`{key}` {kind}, ids binary, _hash long, _near long")


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = 4096) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = written(tokenised(docs, path, key, text), "packing-ids")
    n, total = tokens.agg(F.count(F.lit(1)), F.sum("n")).first()
    kind = docs.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    df = document_frequencies(tokens)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    mean_length = (total or 1) / max(n, 1)

    def run(group: pa.Table) -> pa.Table:
        near = group.column("_near")[0].as_py()
        group = group.sort_by([("_hash", "ascending"), (key, "ascending"), ("ids", "ascending")])
        ids = [np.frombuffer(x.as_py(), "<u2") for x in group.column("ids")]
        pieces, sequence, first = [], near << 32, 0
        # A neighbourhood that came out larger is packed in parts.
        part = np.cumsum([2 * len(x) for x in ids]) // (4 * NEAR_BYTES)
        for last in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(ids)]:
            made = at_powers_of_two(pack_neighbourhood(ids[first:last], shared.value, mean_length, window), window)
            pieces += [(d + first, start, size, sequence + q, at) for d, start, size, q, at in made]
            first, sequence = last, pieces[-1][3] + 1
        doc, start, length, sequences, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
        crc = [zlib.crc32(ids[d][s : s + k].astype("<u4").tobytes()) for d, s, k in zip(doc, start, length, strict=True)]
        return pa.table({
            key: group.column(key).take(pa.array(doc)), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": np.array([len(x) for x in ids], np.int64)[doc], "sequence_id": sequences, "offset": offset,
        })

    return dealt(tokens, sign_tables(idf, df, n), key, total or 0).groupBy("_near").applyInArrow(run, out)
