"""Quality by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

Texts are cut into runs of word characters and runs of punctuation; a token that
repeats the one before it counts as one "again" token. Unigrams and bigrams are
hashed into BUCKETS. The target model is estimated from labelled good rows (at
most MAX_LABELLED, those with the smallest hash of their id), the raw model from
all documents. A document's log weight is the log ratio of the two models over
its n-grams; the k largest log weight + Gumbel noise are kept, which samples
without replacement in proportion to the weights. The noise is a hash of the
id, so a rerun keeps the same rows. k is the number of documents whose log
weight reaches the level that best parts the labelled good rows from the rest.

Defined results: null counts as empty, whose log weight is 0; equal texts have
equal weights; an empty table or a table without labelled rows keeps every row
(there is no target to resample to); repeated ids are rows of their own; other
columns of the documents pass by, clashing names in labels are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import kernels as K
from assayer.llm.tables import refuse_clashes, written

BUCKETS = 1 << 15
MAX_LABELLED = 200_000
SMOOTHING = 0.5
_KIND = np.ones(256, np.uint8)
_KIND[:128] = [0 if c in (32, 9, 10, 11, 12, 13) else 1 if chr(c).isalnum() else 2 for c in range(128)]
_AGAIN = np.uint64(0x51ED270B153A4D2F)


def ngram_buckets(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the text (its place) of each."""
    d, o = texts.data, texts.offsets
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[d]
    start = np.ones(len(d), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[o[:-1][o[:-1] < len(d)]] = True
    s = np.flatnonzero(start)
    k = np.arange(len(d)) - np.repeat(s, np.diff(np.append(s, len(d))))
    lower = d + ((d >= 65) & (d <= 90)) * np.uint8(32)
    shout = (d >= 65) & (d <= 90)
    h = np.add.reduceat((lower.astype(np.uint64) + np.uint64(1)) * K.powers(int(k.max()) + 1)[k], s)
    size = np.diff(np.append(s, len(d)))
    loud = (np.add.reduceat(shout.astype(np.int64), s) == size) & (size > 1)
    h = K.mix(h + size.astype(np.uint64))
    words = kind[s] > 0
    h, text = h[words], np.searchsorted(o, s[words], side="right") - 1
    h[loud[words]] ^= _AGAIN << np.uint64(1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    h[same] = _AGAIN
    pair = K.mix(h[:-1] * K.MULT + h[1:])[text[1:] == text[:-1]]
    shift = np.uint64(65 - BUCKETS.bit_length())
    both = np.concatenate([h >> shift, pair >> shift]).astype(np.int64)
    return both, np.concatenate([text, text[1:][text[1:] == text[:-1]]])


def _counts(docs: DataFrame, text: str) -> np.ndarray:
    """Occurrences of each bucket: at most BUCKETS rows reach the driver, whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for part in K.blocks(K.buffers(b.column(0))):
                total += np.bincount(ngram_buckets(part)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"]
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, train: Column, bound: int) -> DataFrame:
    """(key, text, label) of at most `bound` labelled rows that train, those with the smallest hash of their id."""
    rows = labels.select(F.col(key).alias("_id"), F.col(label).alias("_label")).where(F.col("_label").isNotNull() & F.col("_id").isNotNull())
    rows = rows.where(train).orderBy(F.xxhash64("_id"), "_id").limit(bound)
    return docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(rows, "_id")


def log_weights(docs: DataFrame, ratio: np.ndarray, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in keep, log_weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    source = docs.select(text, key, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for part in K.blocks(K.buffers(b.column(0))):
                bucket, at = ngram_buckets(part)
                out[part.first : part.first + len(part)] = np.bincount(at, weights=shared.value[bucket], minlength=len(part))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out)], names=[key, *keep, "log_weight"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (key, *keep))
    return source.mapInArrow(run, f"{fields}log_weight double")


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value (0 < k <= rows), exact, by histograms that narrow to one value; no sort, no collect."""
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    above = 0
    while lo < hi:
        width = (hi - lo) / bins
        if not lo + width > lo:
            width = float(np.nextafter(lo, np.inf)) - lo
        bin_of = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        rows = values.where((F.col(column) >= lo) & (F.col(column) <= hi)).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
        if len(rows) == 1 and hi - lo >= width * bins:
            break
    return float(lo)


def gumbel(key: str, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def best_level(rows) -> float:
    """The level with the fewest labelled rows on the wrong side, in the middle of the gap; rows are at most MAX_LABELLED."""
    rows = rows.sort_values("log_weight")
    w, good = rows["log_weight"].to_numpy(), rows["_label"].to_numpy() == 1
    wrong = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([np.cumsum(~good[::-1])[::-1], [0]])
    wrong[1:-1][w[1:] == w[:-1]] = len(w) + 1
    i = int(np.argmin(wrong))
    if i == 0:
        return float(w[0])
    return float((w[i - 1] + w[i]) / 2) if i < len(w) else float(np.nextafter(w[-1], np.inf))


def importance_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", seed: int = 777, train: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in keep, log_weight, sample_key, kept: every document with its weight, its Gumbel key, and
    whether it is among the top k. keep with a name of the result raises ValueError."""
    refuse_clashes(keep, key, "log_weight", "sample_key", "kept")
    train = F.lit(True) if train is None else train
    sample = written(labelled_texts(docs, labels, label, key, text, train, MAX_LABELLED), "quality-labelled")
    good = sample.where(F.col("_label") == 1)
    target, raw = _counts(good, "_text"), _counts(docs, text)
    n_good = target.sum()
    if not n_good:
        return docs.select(key, *keep, F.lit(0.0).alias("log_weight"), gumbel(key, seed).alias("sample_key"), F.lit(True).alias("kept"))
    ratio = np.log((target + SMOOTHING) / (n_good + SMOOTHING * BUCKETS)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS))
    weighed = written(log_weights(docs, ratio, key, text), "quality-weights")
    level = best_level(log_weights(sample, ratio, "_id", "_text", ("_label",)).select("_label", "log_weight").toPandas())
    k = weighed.where(F.col("log_weight") >= level).count()
    keyed = lambda df: df.withColumn("sample_key", F.col("log_weight") + gumbel(key, seed))
    bound = kth_largest(keyed(weighed), "sample_key", k) if k else float("inf")
    return keyed(log_weights(docs, ratio, key, text, keep)).withColumn("kept", F.col("sample_key") >= bound)
