"""Exact BM25 top-k: sharded inverted indexes with block-max dynamic pruning, merged under global statistics.

Documents are dealt into shards by a hash of their id. A shard's index (postings
with term frequencies, document lengths) is built once and stored; document
frequencies, the number of documents and their mean length are those of the
whole table, so scores from all shards compare and the merge of the shards' best
k is exact.

Queries are taken in blocks of about QUERY_BYTES, each broadcast to the shards.
In a shard documents lie in blocks of BLOCK of like ones, and each term's
largest impact in each block is known. A batch of like queries sums these for
its terms; blocks are taken by how far that sum exceeds a query's threshold, its
k-th best score so far, which rises meanwhile, and a block is scored only for the
queries of the batch that can gain from it. Impacts of common terms are summed
for all of these at once in 32 bits; what comes within the error of that of the
threshold is scored again in 64 bits, term by term. A few shards go first, and
their k-th best scores are the thresholds that the others start from.

Defined results: the terms of a query are its distinct words (A-Z lower-cased);
a document scores if it shares a term with the query, so a blank or null text
finds and is found by nothing; equal scores go by ascending id, at the k-th place
too; a document is found by its own query; rows with one id are one document and
one query, the row with the least text, null counting as empty; fewer than k
scoring documents give fewer rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import kernels as K
from assayer.llm.tables import discard, pieces, volume, written

SHARD_BYTES = 12 << 20
#: What a row counts beside its text, so that many short texts make many shards.
ROW_BYTES = 256
QUERY_BYTES = 16 << 20
BLOCK = 64
#: Queries that are searched together, and blocks that are scored before thresholds rise again.
BATCH, STEP = 256, 16
#: One shard in so many goes first.
AHEAD = 8
K1, B = 1.2, 0.75


def _terms(texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text the sorted distinct word codes with their frequencies: codes, frequencies, number per text, words per text."""
    codes, tf, n, words = [], [], [], []
    for part in K.blocks(texts):
        h, c = K.word_hashes(part)
        doc = np.repeat(np.arange(len(c), dtype=_number(len(c))), c)
        order = np.argsort(h)
        order = order[np.argsort(doc[order], kind="stable")]
        h, doc = h[order], doc[order]
        at, ends = cuts_of_pairs(doc, h)
        codes.append(h[at])
        tf.append(ends - at)
        n.append(np.bincount(doc[at], minlength=len(c)))
        words.append(c)
    cat = lambda v, kind: np.concatenate(v) if v else np.zeros(0, kind)
    return cat(codes, np.uint64), cat(tf, np.int64), cat(n, np.int64), cat(words, np.int64)


def _number(n: int) -> type:
    """What holds the numbers below n: a stable sort of 16 bits goes by digits, which takes a quarter of the time."""
    return np.uint16 if n <= 1 << 16 else np.int64


def cuts_of_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return at, np.append(at[1:], len(a))[: len(at)]


def _signatures(codes: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The commonest term of each text: like texts come together in its order."""
    out = np.zeros(len(n), np.uint64)
    if len(codes):
        order = np.lexsort((-tf, np.repeat(np.arange(len(n)), n)))
        out[n > 0] = codes[order[(np.cumsum(n) - n)[n > 0]]]
    return out


_FIELDS = {"ids": "<i8", "words": "<i4", "vocabulary": "<u8", "starts": "<i4", "docs": "<i4", "tf": "<u4"}


def _build(key: str):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column(key).to_numpy()
        codes, tf, n, words = _terms(K.buffers(group.column("_text")))
        by = np.lexsort((ids, words, _signatures(codes, tf, n)))
        move = K.ranges((np.cumsum(n) - n)[by], n[by])
        codes, tf, doc = codes[move], tf[move], np.repeat(np.arange(len(n)), n[by])
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)])
        made = {"ids": ids[by], "words": words[by], "vocabulary": codes[starts], "starts": np.append(starts, len(codes)), "docs": doc[order], "tf": tf[order]}
        columns = {c: pa.array([made[c].astype(kind).tobytes()], pa.binary()) for c, kind in _FIELDS.items()}
        return pa.table({"_shard": group.column("_shard")[:1], "n_docs": pa.array([len(ids)], pa.int64()), "n_words": pa.array([int(words.sum())], pa.int64())} | columns)

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: np.frombuffer(b.column(c)[i].as_py(), kind) for c, kind in _FIELDS.items()}


class Shard:
    """A shard's postings of the terms (sorted codes) that a block of queries has, with impacts under their idf."""

    def __init__(self, row: dict[str, np.ndarray], terms: np.ndarray, idf: np.ndarray, mean: float):
        self.ids, n = row["ids"], len(row["ids"])
        at = np.minimum(np.searchsorted(row["vocabulary"], terms), max(len(row["vocabulary"]) - 1, 0))
        here = row["vocabulary"][at] == terms if len(row["vocabulary"]) else np.zeros(len(terms), bool)
        first = np.where(here, row["starts"][at], 0).astype(np.int64)
        self.size = np.where(here, row["starts"][at + 1] if len(row["vocabulary"]) else 0, 0) - first
        spot = K.ranges(first, self.size)
        self.start = np.cumsum(self.size) - self.size
        self.doc, tf = row["docs"][spot].astype(np.int64), row["tf"][spot].astype(np.float64)
        term = np.repeat(np.arange(len(terms)), self.size)
        self.impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * row["words"][self.doc] / mean))
        # Terms that many documents have are whole rows, cut into blocks; of the others the few documents.
        common = np.flatnonzero(self.size > n // 32)
        self.row = np.full(len(terms), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((-(-n // BLOCK), len(common), BLOCK), np.float32)
        often = self.row[term] >= 0
        self.rows[self.doc[often] // BLOCK, self.row[term[often]], self.doc[often] % BLOCK] = self.impact[often]
        self.most = self.rows.max(axis=2)
        order = np.argsort(self.doc.astype(_number(n)), kind="stable")
        self.own_term, self.own_impact = term[order], self.impact[order]
        self.own_start = np.searchsorted(self.doc[order], np.arange(n + 1))
        self.few, self.mark, self.numbers = (self.row < 0) & (self.size > 0), np.zeros(len(terms), bool), np.arange(len(self.doc))

    def search(self, terms: np.ndarray, counts: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best documents of each query of a batch, as far as they reach its least score."""
        n, some, row = len(counts), np.repeat(np.arange(len(counts)), counts), self.row[terms]
        used, place = np.unique(row[row >= 0], return_inverse=True)
        asked = np.zeros((n, len(used)), np.float32)
        asked[some[row >= 0], place] = 1
        score = self._rare(terms, counts)
        bound = asked @ self.most[:, used].T + score.max(axis=2)
        slack = float((int(counts.max(initial=0)) + 8) * 2.0**-22)
        floor = lambda v: np.where(v > 0, v * np.float32(1 - slack), np.float32(1e-30))
        least = least.astype(np.float32)
        need = floor(least)
        best = np.full((n, k), -np.inf, np.float32)
        open_ = np.ones(bound.shape[1], bool)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            gain = (bound - need[:, None]).max(axis=0)
            blocks = np.flatnonzero(open_ & (gain >= 0))
            if not len(blocks):
                break
            blocks = blocks[np.argsort(-gain[blocks], kind="stable")[:STEP]]
            open_[blocks] = False
            for b in blocks.tolist():
                asks = np.flatnonzero(bound[:, b] >= need)
                got = asked[asks] @ self.rows[b][used] + score[asks, b]
                q, d = np.nonzero(got >= need[asks, None])
                if not len(q):
                    continue
                kept.append((asks[q], b * BLOCK + d, got[q, d]))
                hit = np.unique(q)
                pool = np.concatenate([best[asks[hit]], got[hit]], axis=1)
                best[asks[hit]] = pool = -np.partition(-pool, k - 1, axis=1)[:, :k]
                least[asks[hit]] = np.maximum(least[asks[hit]], pool.min(axis=1))
                need[asks[hit]] = floor(least[asks[hit]])
        q, d, s = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        near = s >= need[q]
        return self._exact(terms, counts, q[near], d[near], k)

    def _rare(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Queries x blocks x BLOCK: what the terms that are no rows add. A query at a time, so that its arrays stay in cache."""
        blocks, end = len(self.rows), 0
        out = np.zeros((len(counts), blocks, BLOCK), np.float32)
        for i, c in enumerate(counts.tolist()):
            rare, end = terms[end : end + c], end + c
            rare = rare[self.few[rare]]
            size = self.size[rare]
            spot = np.repeat(self.start[rare] - np.cumsum(size) + size, size)
            spot += self.numbers[: len(spot)]
            out[i] = np.bincount(self.doc.take(spot), self.impact.take(spot), blocks * BLOCK).reshape(blocks, BLOCK)
        return out

    def _exact(self, terms: np.ndarray, counts: np.ndarray, q: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The candidates' scores, summed in the order of the terms, and the k best of each query."""
        order, ends, score = np.argsort(q, kind="stable"), np.cumsum(counts), np.zeros(len(q))
        q, d = q[order], d[order]
        first, last, cuts = self.own_start[d].tolist(), self.own_start[d + 1].tolist(), np.searchsorted(q, np.arange(len(counts) + 1)).tolist()
        for i in np.unique(q).tolist():
            own = terms[ends[i] - counts[i] : ends[i]]
            self.mark[own] = True
            for j in range(cuts[i], cuts[i + 1]):
                hit = self.mark[self.own_term[first[j] : last[j]]]
                score[j] = np.cumsum(self.own_impact[first[j] : last[j]][hit])[-1]
            self.mark[own] = False
        order = np.lexsort((self.ids[d], -score, q))
        q, d, score = q[order], d[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        first = rank < k
        return q[first], self.ids[d[first]], score[first]


def _frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents of all shards each term occurs; as many rows as terms reach the driver at most."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = sent.value, np.zeros(len(sent.value), np.int64)
        for b in batches:
            for v, starts in zip(b.column(0), b.column(1), strict=True):
                vocabulary, starts = np.frombuffer(v.as_py(), "<u8"), np.frombuffer(starts.as_py(), "<i4")
                at = np.searchsorted(terms, vocabulary)
                here = np.flatnonzero(at < len(terms))
                here = here[terms[at[here]] == vocabulary[here]]
                total[at[here]] += starts[here + 1] - starts[here]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    rows = index.select("vocabulary", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    sent.destroy()
    out = np.zeros(len(terms))
    out[rows["term"].to_numpy(np.int64)] = rows["n"]
    return out


def _found(index: DataFrame, key: str, block: Broadcast, k: int, mean: float) -> DataFrame:
    """query_id, key, score: each query's k best of each shard, as far as they reach its least score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, idf, asked, terms, counts, least = block.value
        ends = np.cumsum(counts)
        least = least.copy()
        for row in _shards(batches):
            shard = Shard(row, codes, idf, mean)
            for x in range(0, len(asked), BATCH):
                y = min(x + BATCH, len(asked))
                q, ids, score = shard.search(terms[ends[x] - counts[x] : ends[y - 1]], counts[x:y], least[x:y], k)
                full = np.bincount(q, minlength=y - x) == k
                worst = np.full(y - x, np.inf)
                np.minimum.at(worst, q, score)
                least[x:y] = np.where(full, np.maximum(least[x:y], worst), least[x:y])
                yield pa.RecordBatch.from_arrays([pa.array(asked[x + q]), pa.array(ids), pa.array(score)], names=["query_id", key, "score"])

    return index.select(*_FIELDS).mapInArrow(run, f"query_id long, `{key}` long, score double")


def top_k(docs: DataFrame, is_query: Column, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, rank, key, score: for each row that is_query, the k best of all rows. Rows with a null id take no part."""
    sc = docs.sparkSession.sparkContext
    docs = docs.where(F.col(key).isNotNull())
    rows, size = volume(docs, text)
    n = pieces(size + ROW_BYTES * rows, SHARD_BYTES)
    plain = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(n)).alias("_shard"))
    single = plain.repartition("_shard").groupBy("_shard", key).agg(F.min("_text").alias("_text"))
    kinds = ", ".join(f"{c} binary" for c in _FIELDS)
    index = written(single.groupBy("_shard").applyInArrow(_build(key), f"_shard long, n_docs long, n_words long, {kinds}"), "topk-index")
    n_docs, words = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n_docs, mean = n_docs or 0, max((words or 0) / max(n_docs or 0, 1), 1e-9)
    asked = docs.where(is_query).groupBy(F.col(key).cast("long").alias("_id")).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("_text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, tf, c, _ = _terms(K.buffers(b.column(1)))
            ends = np.cumsum(c)
            sign = pa.array((_signatures(codes, tf, c) >> np.uint64(1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), sign, pa.array([codes[y - x : y].tobytes() for x, y in zip(c, ends, strict=True)], pa.binary())], names=["_id", "_sign", "codes"])

    queries = written(asked.mapInArrow(terms, "_id long, _sign long, codes binary"), "topk-queries")
    blocks = pieces(volume(queries.select("codes"), "codes")[1], QUERY_BYTES)
    merged = None
    for i in range(blocks):
        rows = sorted((r["_sign"], r["_id"], r["codes"]) for r in queries.where((F.pmod(F.xxhash64("_id"), F.lit(blocks)) == i) & (F.octet_length("codes") > 0)).collect())
        flat = np.concatenate([np.frombuffer(c, np.uint64) for *_, c in rows]) if rows else np.zeros(0, np.uint64)
        codes, place = np.unique(flat, return_inverse=True)
        df = _frequencies(index, codes)
        base = (codes, np.log(1 + (n_docs - df + 0.5) / (df + 0.5)), np.array([r[1] for r in rows], np.int64), place, np.array([len(c) // 8 for *_, c in rows], np.int64))
        least, ahead = np.zeros(len(rows)), -(-n // AHEAD)
        first = sc.broadcast((*base, least))
        part = written(_found(index.where(F.col("_shard") < ahead), key, first, k, mean), "topk-ahead")
        known = {r["query_id"]: r["s"] for r in _kth(part, k).collect()}
        second = sc.broadcast((*base, np.array([known.get(r[1], 0.0) for r in rows])))
        part = part.unionByName(written(_found(index.where(F.col("_shard") >= ahead), key, second, k, mean), "topk-block"))
        merged = part if merged is None else merged.unionByName(part)
        first.destroy()
        second.destroy()
    discard(index)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def _kth(found: DataFrame, k: int) -> DataFrame:
    """query_id, s: the k-th best score of the queries that have so many."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", F.col("score").alias("s"))
