"""Operators by group against plain Python where one group holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import compare as M
from assayer.operators import sampling as S


def spans(rows, width):
    out = []
    for g in {g for g, _ in rows}:
        start = last = None
        for x in sorted({x for h, x in rows if h == g}):
            if start is None or x - start >= width:
                out += [(g, start, last - start + 1)] if start is not None else []
                start = x
            last = x
        out.append((g, start, last - start + 1))
    return sorted(out)


@pytest.mark.parametrize("width", [3, 100])
def test_spans(spark, width):
    rnd = random.Random(width)
    rows = [("hot", rnd.randrange(60_000)) for _ in range(4000)] + [("dense", i * 2) for i in range(30_000, 36_000)] + [(f"g{i}", rnd.randrange(-500, 500)) for i in range(200)] + [("neg", -(10**12) + i) for i in range(5)]
    df = spark.createDataFrame([*rows, (None, 1), ("hot", None)], "g string, x long")
    got = M.coalesce_spans(df, "g", "x", width)
    assert sorted(map(tuple, got.collect())) == spans(rows, width)
    assert M.coalesce_spans(df.where("false"), "g", "x").count() == 0


def test_a_hot_group_is_not_one_task(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).select(F.lit("one").alias("g"), (F.col("id") * 200).alias("x"))
        assert max(len(p) for p in M.coalesce_spans(rows, "g", "x").rdd.glom().collect()) < 15_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_quantile(spark, q):
    rnd = random.Random(5)
    rows = [("a", float(rnd.randrange(5))) for _ in range(999)] + [("b", 7.0)] + [(None, 1.0), (None, 2.0)] + [("c", rnd.random() * 1e9) for _ in range(40)]
    got = {r.g: r.quantile for r in M.exclusive_quantile(spark.createDataFrame([*rows, ("a", None)], "g string, v double"), "v", q, "g").collect()}
    for g in {g for g, _ in rows}:
        v = sorted(x for h, x in rows if h == g)
        at = max(1.0, min(len(v), (len(v) + 1) * q))
        lo = int(at)
        want = v[lo - 1] + (at - lo) * (v[min(lo, len(v) - 1)] - v[lo - 1])
        assert got[g] == pytest.approx(want)


def test_interleaving(spark):
    rows = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(500)] + [(1000, None)], "frame_id long, arm string")
    got = S.interleave(rows, "arm", "x").orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 502))
    for n in (100, 250, 400):
        assert abs(sum(r.arm == "small" for r in got[:n]) - n / 10) <= 1.5
