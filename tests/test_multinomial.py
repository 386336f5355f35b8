"""The tree resampler: the law of its draws, hostile cells, agreement with plain sums, and tasks side by side."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import multinomial as T


@pytest.mark.parametrize(("n", "p"), [(1, 0.5), (5, 0.3), (64, 0.5), (65, 0.5), (1000, 0.02), (1000, 0.005), (100_000, 0.5), (10**9, 0.3), (1000, 0.9), (80, 0.99), (10**12, 1e-12)])
def test_binomial_has_its_moments(n, p):
    b = np.arange(100_000)
    k = T.binomial(np.full(len(b), n), np.full(len(b), p), T._key(1, b, 2, np.full(len(b), 3)))
    assert k.min() >= 0 and k.max() <= n
    sd = max((n * p * (1 - p)) ** 0.5, 1e-9)
    assert abs(k.mean() - n * p) < 5 * sd / len(b) ** 0.5 and abs(k.var() / sd**2 - 1) < 0.03


@pytest.mark.parametrize(("n", "p"), [(30, 0.4), (70, 0.4), (200, 0.04)])
def test_binomial_has_its_distribution(n, p):
    import math

    b = np.arange(200_000)
    k = T.binomial(np.full(len(b), n), np.full(len(b), p), T._key(5, b, 1, np.full(len(b), 0)))
    mass = np.array([math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(n + 1)])
    seen = np.bincount(k, minlength=n + 1) / len(b)
    assert np.abs(np.cumsum(seen) - np.cumsum(mass)).max() < 1.63 / len(b) ** 0.5


def test_split_is_multinomial():
    w = np.array([3, 0, 5, 1, *[1] * 60])
    d = T.split(w, np.full(20_000, w.sum()), 0, 0, 9)
    assert (d.sum(axis=1) == w.sum()).all() and (d[:, 1] == 0).all()
    assert np.abs(d.mean(axis=0) - w).max() < 0.06 and abs(np.cov(d[:, 0], d[:, 2])[0, 1] + 15 / 69) < 0.08
    parts = np.concatenate([T.split(w, np.full(500, w.sum()), 0, 0, 9, x) for x in range(0, 20_000, 500)])
    assert (parts == d).all()


def test_more_cells_than_one_tier_holds(spark, monkeypatch):
    monkeypatch.setattr(T, "BITS", 3)
    monkeypatch.setattr(T, "FAN", 8)
    rows = spark.range(500).select((F.col("id") % 7 + F.col("id") / 1000).alias("v"), F.lit(1).alias("k"), F.lit(1.0).alias("one"))
    sums = T.resample_sums(rows, [], ["v"], "k", ["one", "v"], 300)
    got = sums.toPandas()
    mean, sd = rows.agg(F.avg("v"), F.stddev_pop("v")).first()
    assert (got["one"] == 500).all() and sorted(got["b"]) == list(range(300))
    m = got["v"] / got["one"]
    assert abs(m.mean() - mean) < 4 * sd / (500 * 300) ** 0.5 and abs(m.std() / (sd / 500**0.5) - 1) < 0.15


def test_wide_trees_equal_deep_ones(spark, monkeypatch):
    rows = spark.range(40).select(F.col("id").cast("double").alias("v"))
    wide = T.mean_interval(rows, "v", [], 100).first()
    monkeypatch.setattr(T, "BITS", 2)
    monkeypatch.setattr(T, "FAN", 4)
    assert T.mean_interval(rows, "v", [], 100).first() == wide


def test_hostile_cells(spark):
    rows = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "y"), ("a", None, "z"), (None, 2.0, "x"), (None, 2.0, None), ("c", None, "x")], "task string, v double, cluster string")
    iid = {r.task: (r.lo, r.hi) for r in T.mean_interval(rows, "v", ["task"], 400).collect()}
    assert iid == {"a": (1.0, 3.0), None: (2.0, 2.0)}
    by_cluster = {r.task: (r.lo, r.hi) for r in T.clustered_interval(rows, "v", "cluster", ["task"], 400).collect()}
    assert by_cluster == iid
    assert tuple(T.mean_interval(rows.where("false"), "v", [], 10).first()) == (None, None)


def test_tasks_with_the_same_clusters_share_resamples(spark):
    one = spark.range(300).select((F.col("id") % 11).alias("cluster"), (F.col("id") % 3 == 0).cast("double").alias("value"))
    rows = one.withColumn("task", F.lit("t")).unionByName(one.withColumn("task", F.lit("u"))).unionByName(one.withColumn("task", F.lit("all alike")).withColumn("value", F.lit(1.0)))
    tasks = spark.createDataFrame([("t",), ("u",), ("all alike",), ("nobody",)], "task string")
    got = {r.task: r for r in T.design_effects(rows, tasks, "value", "cluster", resamples=500).collect()}
    assert got["t"][1:] == got["u"][1:] and got["t"].clusters == 11 and got["t"].design_effect > 0
    assert got["all alike"].design_effect is None and got["all alike"].why_absent is None
    assert got["nobody"].n == 0 and got["nobody"].point is None and "nobody" not in (got["nobody"].why_absent or "nobody")
    alone = T.clustered_interval(one, "value", "cluster", [], 500).first()
    assert (got["t"].cluster_lo, got["t"].cluster_hi) == (alone.lo, alone.hi)
