"""Importance resampling by word tries against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from brute import SCHEMA, hostile

from assayer.llm import target_tries as tt

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").encode().lower())
    return len(w), [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, buckets=10_000, percent=5):
    s, t = (collections.Counter(zlib.crc32(f) % buckets for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        n, f = features(x)
        weight, score = sum(gain[zlib.crc32(g) % buckets] for g in f), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, len(f), weight, score, None])
    enter = sorted((r for r in out if r[1] >= 20 and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(enter[: percent * len(enter) // 100], 1):
        r[5] = k
    return [(r[0], *r[2:]) for r in out]


def listed(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [4 << 20, 2000])
def test_driver_tables(spark, block, monkeypatch):
    monkeypatch.setattr(tt, "BLOCK_BYTES", block)
    docs, target = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert listed(tt.resample(docs, target)) == sorted(brute(rows, [r.text for r in target.collect()]), key=str)


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_hostile_tables(spark, percent):
    bad = hostile(spark)
    many = bad.unionByName(spark.createDataFrame([(1000 + i, "one and the same text of more than twenty words, " * 5, None, None, None, "clash", 0.5) for i in range(60)], SCHEMA))
    rows = [(r.doc_id, r.text) for r in many.select("doc_id", "text").collect()]
    target = spark.createDataFrame([(1, None), (2, ""), (3, "the same text alpha beta alpha beta")], "item_id long, text string")
    got = tt.resample(many, target, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert listed(got) == sorted(brute(rows, [None, "", "the same text alpha beta alpha beta"], percent=percent), key=str)


def test_empty_tables(spark):
    empty, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert tt.resample(empty, some).count() == 0
    assert listed(tt.resample(some, empty, percent=100)) == brute([(1, "word " * 30)], [], percent=100)


def test_states_go_on_from_the_parent():
    shifts, rng = tt.Shifts(), np.random.default_rng(5)
    heads, tails = ([rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in rng.integers(1, 60, 300)] for _ in range(2))
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = shifts.extend(crc(heads), crc(tails), np.array([len(t) for t in tails]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(heads, tails, strict=True)]
    long = [b"w" * 200 + b" " + b"\xc3\xa9" * 90 + b" x"]
    trie, _, _ = tt.Tries(3).of(long)
    assert [int(s) for _, state, _, _ in trie.levels for s in state] == [zlib.crc32(f) for _, f in [features(long[0].decode())] for f in f]
