"""Importance resampling against plain Python: buckets, weights, level, Gumbel keys and the top k, with ties and repeated rows."""

import collections
import itertools
import math

import pytest
from brute import hostile
from pyspark.sql import functions as F

from assayer.llm import quality

DATA = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def mix(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & M64
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & M64
    return x ^ (x >> 32)


def kind(c):
    return 1 if c >= 128 or chr(c).isalnum() else 0 if c in b" \t\n\r\x0b\x0c" else 2


def buckets(text):
    tokens = []
    for k, run in itertools.groupby((text or "").encode(), kind):
        run = bytes(run)
        if k:
            h = mix((sum((c + 1) * pow(0xD1342543DE82EF95, i, 1 << 64) for i, c in enumerate(run.lower())) + len(run)) & M64)
            loud = len(run) > 1 and all(65 <= c <= 90 for c in run)
            tokens.append(h ^ (0x51ED270B153A4D2F << 1 & M64) if loud else h)
    again = [i > 0 and tokens[i] == tokens[i - 1] for i in range(len(tokens))]
    h = [0x51ED270B153A4D2F if a else t for t, a in zip(tokens, again, strict=True)]
    pairs = [mix((a * 0x9E3779B97F4A7C15 + b) & M64) for a, b in itertools.pairwise(h)]
    return [x >> 49 for x in h + pairs]


def brute(rows, labels, noise):
    """[(id, log_weight, kept)] for rows (id, text); noise: Gumbel noise by id."""
    raw, good = collections.Counter(), collections.Counter()
    known = [(i, t, y) for i, t in rows for j, y in labels if i is not None and i == j and y is not None]
    for _, t in rows:
        raw.update(buckets(t))
    for _, t, y in known:
        good.update(buckets(t) if y == 1 else ())
    n, g = sum(raw.values()), sum(good.values())
    if not g:
        return [(i, 0.0, True) for i, _ in rows]
    b = 1 << 15
    ratio = lambda x: math.log((good[x] + 0.5) / (g + 0.5 * b)) - math.log((raw[x] + 0.5) / (n + 0.5 * b))
    weight = [sum(map(ratio, buckets(t))) for _, t in rows]
    seen = sorted((sum(map(ratio, buckets(t))), y == 1) for _, t, y in known)
    cuts = [(sum(y for w, y in seen[:i]) + sum(not y for w, y in seen[i:]), i) for i in range(len(seen) + 1) if not 0 < i < len(seen) or abs(seen[i][0] - seen[i - 1][0]) > 1e-9]
    i = min(cuts)[1]
    level = seen[0][0] if i == 0 else math.inf if i == len(seen) else (seen[i][0] + seen[i - 1][0]) / 2
    k = sum(w >= level - 1e-9 for w in weight) if i == 0 else sum(w >= level for w in weight)
    keys = [w + noise[r[0]] for w, r in zip(weight, rows, strict=True)]
    bound = sorted(keys, reverse=True)[k - 1] if k else math.inf
    return [(r[0], w, key >= bound - 1e-9) for r, w, key in zip(rows, weight, keys, strict=True)]


def compare(docs, labels):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel("doc_id", 777).alias("g")).collect()}
    want = brute(rows, [(r.doc_id, r.quality) for r in labels.collect()], noise)
    got = quality.importance_sample(docs, labels).collect()
    order = lambda x: (str(x[0]), round(x[1], 6), x[2])
    got, want = sorted(((r.doc_id, r.log_weight, r.kept) for r in got), key=order), sorted(want, key=order)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-6 * (1 + abs(w[1])) for g, w in zip(got, want, strict=True))
    assert [g[2] for g in got] == [w[2] for w in want]
    return got


def test_driver_tables(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    kept = compare(docs, labels)
    assert 0 < sum(k for _, _, k in kept) < len(kept)


@pytest.mark.parametrize("good", [{4, 7}, {4, 5, 8}, set(), {2}])
def test_hostile_tables(spark, good):
    docs = hostile(spark)
    labels = spark.createDataFrame([(i, int(i in good)) for i in (2, 3, 4, 5, 7, 8, 9)] + [(None, 1), (10, None)], "doc_id long, quality int")
    compare(docs, labels)
    compare(docs.unionByName(docs), labels)


def test_no_rows(spark):
    docs = hostile(spark)
    labels = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    assert quality.importance_sample(docs.where("false"), labels).count() == 0
    assert all(r.kept for r in quality.importance_sample(docs, labels.where("false")).collect())


def test_equal_weights_are_drawn_evenly(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same words").alias("text"))
    keys = rows.select(quality.gumbel("doc_id", 777).alias("g"))
    cut = quality.kth_largest(keys, "g", 300)
    assert keys.where(F.col("g") >= cut).count() == 300 and abs(keys.agg(F.avg("g")).first()[0] - 0.5772) < 0.1
