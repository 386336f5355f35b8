"""Importance resampling towards a target: hashed n-gram features counted and scored by partition-local word tries.

A partition takes its texts in blocks of about BLOCK_BYTES and lays each block's
runs of 1 to `longest` words in a trie: a node is a distinct run, its parent the
run without the last word, and it holds how often the run occurs and the state
of the CRC-32 after the run's bytes, which the state of the parent and the last
word give without reading the run again. A node's count goes to the bucket that
its state names; a partition sends its bucket totals, at most `buckets` rows,
and the totals are summed. In the second pass the same tries get the gain of
their bucket attached to each node, and a document's weight is the sum of the
gains along its paths.

Only totals of buckets are kept between the passes, `buckets` rows whatever the
size of the tables; those are what is broadcast. The draw ranks documents by
ranges of the score, so no task holds more than a range.

Defined results: a null text has no words; a document without features weighs 0;
fewer than `least_words` words take no part in the draw, nor do rows with a null
id, whose score is null; rows that share an id are drawn row by row, ties going
by id; an empty target has T = 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.tables import cores, written
from assayer.llm.word_ids import WordIds, pairs, raw_texts, text_blocks

BLOCK_BYTES = 4 << 20
#: Words numbered before a partition starts its numbers anew.
NUMBERED = 1 << 19
RANGE_ROWS = 1 << 20
#: A-Z become a-z, the bytes that part words become blanks.
_FOLD = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)  # linear part of a byte's step


def _after_zeros(states: np.ndarray, n: int) -> np.ndarray:
    """What n zero bytes make of register values."""
    table = _STEP
    for _ in range(n):
        states = table[states & np.uint32(255)] ^ (states >> np.uint32(8))
    return states


class Shifts:
    """Extends CRC-32 states by words: the state of a run and the CRC of a word of n bytes give that of both.

    A CRC is linear: crc(a + b) = crc(b) xor the register crc(a) after as many zero bytes as b has. For
    each length four tables of 256 entries, one for each byte of the register, hold that; they are made
    when a length is first met. Words over LONG bytes are rare and extended one by one.
    """

    LONG = 64

    def __init__(self):
        self.tables = np.zeros((self.LONG + 2, 4, 256), np.uint32)
        self.made = np.zeros(self.LONG + 2, bool)

    def extend(self, states: np.ndarray, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        """States of states' bytes and then a suffix with this CRC and size (up to LONG + 1)."""
        for n in np.flatnonzero(np.bincount(size, minlength=len(self.made)) > 0):
            if not self.made[n]:
                bytes_ = np.arange(256, dtype=np.uint32)
                for k in range(4):
                    self.tables[n, k] = _after_zeros(bytes_ << np.uint32(8 * k), int(n))
                self.made[n] = True
        out = crc.copy()
        for k in range(4):
            out ^= self.tables[size, k, states >> np.uint32(8 * k) & np.uint32(255)]
        return out


class Trie:
    """The runs of 1 to `longest` words of a block of texts, level by level: counts and CRC states of the nodes, and the node of each position."""

    def __init__(self, tries: Tries, ids: np.ndarray, doc: np.ndarray, longest: int):
        words, tail, size = tries.words, tries.tail, tries.size
        distinct, place, count = np.unique(ids, return_inverse=True, return_counts=True)
        state, at = tries.crc[distinct], np.arange(len(ids))
        self.levels = [(count, state, at, place)]
        for depth in range(2, longest + 1):
            inside = at[: np.searchsorted(at, len(ids) - depth + 1)]  # a path goes on where the next word is of the same text
            on = np.flatnonzero(doc[inside] == doc[inside + depth - 1])
            parent, at = place[on], inside[on]
            if not len(at):
                break
            word = ids[at + depth - 1]
            node, count, place = pairs(parent, word, len(words))
            up, last = node // len(words), node % len(words)
            grown = np.zeros(len(node), np.uint32)
            short = size[last] <= Shifts.LONG + 1
            grown[short] = tries.shifts.extend(state[up[short]], tail[last[short]], size[last[short]])
            for i in np.flatnonzero(~short).tolist():
                grown[i] = zlib.crc32(b" " + words.list[last[i]], int(state[up[i]]))
            state = grown
            self.levels.append((count, state, at, place))


class Tries:
    """Makes the tries of a partition's blocks; the words keep their numbers and CRCs between blocks while there is room."""

    def __init__(self, longest: int):
        self.longest, self.shifts = longest, Shifts()
        self._start()

    def _start(self) -> None:
        self.words, self.crc, self.tail, self.size = WordIds(), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _numbered(self) -> None:
        """CRC of each new word, CRC and size of a blank and the word."""
        new = self.words.list[len(self.crc) :]
        n = len(new)
        self.crc = np.concatenate([self.crc, np.fromiter(map(zlib.crc32, new), np.uint32, n)])
        self.tail = np.concatenate([self.tail, np.fromiter((zlib.crc32(b" " + w) for w in new), np.uint32, n)])
        self.size = np.concatenate([self.size, np.fromiter(map(len, new), np.int64, n) + 1])

    def of(self, texts: list[bytes]) -> tuple[Trie, np.ndarray, np.ndarray]:
        """The trie of the texts, the text of each word, and the number of words of each text."""
        if len(self.words) > NUMBERED:
            self._start()
        split = [t.translate(_FOLD).split() for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        ids = self.words.of([w for ws in split for w in ws])
        self._numbered()
        doc = np.repeat(np.arange(len(texts)), counts)
        return Trie(self, ids, doc, self.longest), doc, counts


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 3, buckets: int = 10_000) -> DataFrame:
    """bucket, n: the features of all texts by bucket; each partition sends its totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, total = Tries(longest), np.zeros(buckets, np.int64)
        for b in text_blocks(batches, BLOCK_BYTES):
            trie, _, _ = tries.of(raw_texts(b.column(0)))
            for count, state, _, _ in trie.levels:
                np.add.at(total, state.astype(np.int64) % buckets, count)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket, gain: floor(1000 ln of the smoothed share in the target over that in the source), for every bucket."""
    spark = source.sparkSession
    total = lambda c, name: c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    sums = total(source, "all_s").join(F.broadcast(total(target, "all_t")), F.lit(True))  # one row
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    d = lambda c: F.col(c).cast("double")
    share = ((d("t") + 1) * (d("all_s") + buckets)) / ((d("s") + 1) * (d("all_t") + buckets))
    return both.join(F.broadcast(sums), F.lit(True)).select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def weights(docs: DataFrame, gains: np.ndarray, key: str, text: str, longest: int) -> DataFrame:
    """key, n_words, n_features, weight of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, gain = Tries(longest), sent.value
        for b in text_blocks(batches, BLOCK_BYTES):
            trie, doc, counts = tries.of(raw_texts(b.column(1)))
            features, weight = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            for _, state, at, place in trie.levels:
                attached = gain[state.astype(np.int64) % len(gain)]
                features += np.bincount(doc[at], minlength=len(counts))
                np.add.at(weight, doc[at], attached[place])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (counts, features, weight))], names=[key, "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variate), the same for the same id and seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """rows with their place in the whole order as column rank: n ranges, numbered inside, after the sizes of those before."""
    dealt = written(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "target-ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).select("_range", "_before")  # n rows
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(before), "_range").withColumn("rank", (F.col("_before") + inside).cast("long")).drop("_range", "_before")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, longest: int = 3, buckets: int = 10_000
) -> DataFrame:
    """key, n_features, weight, score, rank: every row; rank 1, 2, ... of the floor(percent N / 100) drawn of the N rows with enough words."""
    spark = docs.sparkSession
    counts = lambda df, column: written(bucket_counts(df, column, longest, buckets), "target-buckets")
    gains = bucket_gains(counts(docs, text), counts(target, target_text), buckets)
    table = np.zeros(buckets, np.int64)
    for r in gains.collect():  # one row a bucket
        table[r["bucket"]] = r["gain"]
    weighed = written(weights(docs, table, key, text, longest).withColumn("score", F.col("weight") + gumbel(F.col(key), seed)), "target-weights")
    enters = F.col(key).isNotNull() & (F.col("n_words") >= least_words)
    n = weighed.where(enters).count()
    drawn = n * percent // 100
    parts = max(cores(spark), -(-n // RANGE_ROWS))
    best = ranked(weighed.where(enters).select(key, "n_features", "weight", "score"), [F.desc("score"), F.asc(key)], parts)
    rest = weighed.where(~enters).select(key, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    shown = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    return best.select(key, "n_features", "weight", "score", shown).unionByName(rest)
