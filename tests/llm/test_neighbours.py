"""Nearest neighbours against brute force: recall, exact scores, order, and hostile vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import neighbours as nb

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, id string, dim string, score double, x string"


def dot(a, b):
    s = 0.0
    for x, y in zip(a, b, strict=True):
        s += x * y
    return s


def brute(rows, is_query, k=20):
    ok = {}
    for i, v in rows:
        if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v):
            v = [float(np.float32(x)) for x in v]
            ok[i] = min(ok.get(i, v), v, key=lambda u: np.array(u).tobytes())
    return {q: sorted((-dot(ok[q], v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k] for q in ok if is_query(q)}


def compare(got, want, least):
    by = {q: [] for q in want}
    for r in got.orderBy("query_id", "rank").collect():
        by[r.query_id].append((-r.score, r.vec_id))
        assert r["rank"] == len(by[r.query_id])
    hits = total = 0
    for q, found in by.items():
        assert found == sorted(found) and len(found) == len(want[q]) and len({i for _, i in found}) == len(found) and q not in {i for _, i in found}
        hits, total = hits + len({i for _, i in found} & {i for _, i in want[q]}), total + len(want[q])
        known = dict((i, s) for s, i in want[q])
        assert all(known[i] == s for s, i in found if i in known)
    assert hits >= least * total
    return by


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", 0.5, None) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("block", [8192, 7])
def test_driver_table(spark, block, monkeypatch):
    monkeypatch.setattr(nb, "QUERY_ROWS", block)
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    compare(nb.nearest(vectors, F.col("vec_id") % 20 == 0), brute(rows, lambda i: i % 20 == 0), 0.9)


def test_large_table_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(nb, "CELL_ROWS", 256)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16)) * 3
    x = np.concatenate([centres[rng.integers(0, 40, 5000)] + 0.2 * rng.standard_normal((5000, 16)), centres[:1] + 0.01 * rng.standard_normal((1500, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    compare(nb.nearest(table(spark, rows), F.col("vec_id") % 100 == 0, k=10), brute(rows, lambda i: i % 100 == 0, 10), 0.9)


def test_hostile_vectors(spark, monkeypatch):
    monkeypatch.setattr(nb, "CELL_ROWS", 16)
    rng = np.random.default_rng(9)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100)] + [(i, rng.standard_normal(3).tolist()) for i in range(100, 160)]
    rows += [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 2.0]), (280, [float("nan"), 1.0, 2.0]), (300, [float("inf"), 1.0, 2.0]), (None, [9.0, 9.0, 9.0])]
    rows += [(320, [1.0, 2.0]), (340, [3.0, 1.0]), (360, [1.0] * 5), (100, [5.0, 5.0, 5.0]), (380, [-4.0, 0.0, 1000.0]), (400, [1e-30, 0.0, 0.0])]
    got = nb.nearest(table(spark, rows), F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "double"]
    by = compare(got, want := brute(rows, lambda i: i % 20 == 0), 0.9)
    assert 360 not in {q for q, f in by.items() if f} and len(by[320]) == 1
    assert by[0][:3] == want[0][:3]


@pytest.mark.parametrize("n", [0, 1, 2, 21, 22, 45])
def test_small_tables(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(n)]
    compare(nb.nearest(table(spark, rows), F.lit(True)), brute(rows, lambda i: True), 0.9)


def test_queries_that_find_too_few_look_everywhere(spark, monkeypatch):
    monkeypatch.setattr(nb, "FIRST", 1)
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(1200)]
    found = compare(nb.nearest(table(spark, rows), F.col("vec_id") % 40 == 0, success=0.02), brute(rows, lambda i: i % 40 == 0), 0)
    assert all(len(f) == 20 for f in found.values())


def test_no_queries(spark):
    assert nb.nearest(table(spark, [(1, [1.0]), (2, [2.0])]), F.lit(None).cast("boolean")).count() == 0


def test_probes_come_in_order_of_success():
    place = np.array([0.1, 3.45, -2.9])
    slots, chance = nb.probes(place, 0.8, 0.9)
    assert slots[0].tolist() == [0, 3, -3] and (np.diff(chance) <= 1e-15).all() and 0.9 <= chance.sum() < 0.9 + chance[-1] + 1e-12
    rng = np.random.default_rng(2)
    at = np.floor(place + 0.8 * rng.standard_normal((20_000, 3))).astype(int)
    assert abs(np.isin((at * [1, 100, 10_000]).sum(1), (slots * [1, 100, 10_000]).sum(1)).mean() - chance.sum()) < 0.02
