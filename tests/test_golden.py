"""Hand-derived values, edge cases and invariances of the statistics."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.functions import scalars as X
from assayer.functions import schemas
from assayer.operators import agreement as A
from assayer.operators import compare as M
from assayer.operators import pairing as P
from assayer.operators import prevalence as V
from assayer.operators import frames, judging, report, resample, sampling, sensitivity, simulate
from assayer.sources import tar
from assayer.streaming import log


def pairs(spark, cells):
    rows = [(a, b) for (a, b), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "a boolean, b boolean" if isinstance(rows[0][0], bool) else "a int, b int")


def test_boolean_matrix(spark):
    p = pairs(spark, {(True, True): 17, (False, False): 1, (True, False): 1, (False, True): 1})
    r = A.agreement(p, "a", "b", (False, True)).first()
    assert (r.n, r.raw) == (20, pytest.approx(0.9))
    assert r.ac1 == pytest.approx(36 / 41) and r.kappa == pytest.approx(4 / 9)


def test_ternary_matrix(spark):
    m = [[2, 1, 0], [0, 3, 1], [0, 1, 4]]
    p = pairs(spark, {(j, i): m[i][j] for i in range(3) for j in range(3)})
    r = A.agreement(p, "a", "b", (0, 1, 2)).first()
    assert r.raw == pytest.approx(0.75) and r.ac1 == pytest.approx(247 / 391)


def test_all_disagree_and_reversal(spark):
    r = A.agreement(pairs(spark, {(True, False): 10}), "a", "b", (False, True)).first()
    assert r.ac1 < 0 and r.kappa == 0
    r = A.agreement(pairs(spark, {(True, False): 5, (False, True): 5}), "a", "b", (False, True)).first()
    assert r.kappa == pytest.approx(-1)


def test_fleiss(spark):
    answers = ["TTFF", "TTFT", "TFFT"]
    rows = [(f, j, answers[j][f] == "T") for f in range(4) for j in range(3)]
    got = A.fleiss_kappa(spark.createDataFrame(rows, "frame_id int, judge int, v boolean"), "v", (False, True)).first()
    assert got.fleiss == pytest.approx(11 / 35)


@pytest.mark.parametrize(("tuned", "rectifier", "value"), [(False, -0.3, 0.5)])
def test_biased_judge(spark, tuned, rectifier, value):
    gold = spark.createDataFrame([(i < 10, i < 16) for i in range(20)], "y boolean, f boolean")
    pool = spark.createDataFrame([(i < 160,) for i in range(200)], "f boolean")
    r = V.ppi(V.moments(gold, pool, "y", "f"), tuned).first()
    assert r.rectifier == pytest.approx(rectifier) and r.value == pytest.approx(value)


def test_fair_judge(spark):
    gold = spark.createDataFrame([(i < 12, i < 12) for i in range(20)], "y boolean, f boolean")
    pool = spark.createDataFrame([(i < 120,) for i in range(200)], "f boolean")
    r = V.ppi(V.moments(gold, pool, "y", "f")).first()
    assert r.rectifier == pytest.approx(0) and r.value == pytest.approx(0.6)


def test_wilson(spark):
    got = spark.range(1).select(*[X.wilson_lower(F.lit(k), F.lit(n), c).alias(f"w{i}") for i, (k, n, c) in enumerate([(8, 10, 0.975), (3, 10, 0.5), (0, 0, 0.95)])]).first()
    assert got.w0 == pytest.approx(0.4902, abs=1e-4) and got.w1 == pytest.approx(0.3) and got.w2 == 0


def test_unanimity(spark):
    rows = [(0, "P1", True), (0, "P2", True), (0, "P3", True), (1, "P1", False), (1, "P2", False), (1, "P3", True)]
    r = sensitivity.unanimity(spark.createDataFrame(rows, "frame_id int, v string, a boolean"), "a").first()
    assert r.ipr == 0.5 and r.par == pytest.approx(2 / 3)


def test_pairing_policies(spark):
    log_rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string")
    assert {r.k: r.v for r in P.first_wins(log_rows, ["k"], "at").collect()} == {"a": "x", "b": "z"}
    assert {r.k: r.v for r in P.last_wins(log_rows, ["k"], "at").collect()} == {"a": "y", "b": "z"}


def test_gold_without_response_raises(spark):
    gold = spark.createDataFrame([(1, True), (2, True)], "frame_id int, y boolean")
    answers = spark.createDataFrame([(1, "ok", True), (2, "timeout", None)], "frame_id int, status string, f boolean")
    with pytest.raises(Exception, match="no ok response"):
        P.gold_and_unlabelled(gold, answers)[0].collect()


def test_response_violations(spark):
    rows = [
        ("f", "j", "1", "P0", 2, True, ("none", None), "2", "ok", 1, 0.0),
        ("f", "j", "1", "P0", 3, True, ("none", None), "2", "ok", 1, 0.0),
        ("f", "j", "1", "P0", None, True, ("none", None), "2", "ok", 1, 0.0),
        ("f", "j", "1", "P0", None, True, ("none", 0.5), "2", "refused", 1, 0.0),
        ("f", "j", "1", "P0", None, None, ("verbalized", 1.2), "2", "lost", 1, 0.0),
        ("f", "j", "1", "P0", None, None, ("verbalized", None), "", "timeout", 1, 0.0),
    ]
    got = [set(r.v) for r in spark.createDataFrame(rows, schemas.RESPONSE).select(schemas.response_violations().alias("v")).collect()]
    assert got[0] == set()
    assert got[1] == {"hands outside 0 to 2"}
    assert got[2] == {"ok without answers"}
    assert got[3] == {"answers without ok", "value without kind"}
    assert got[4] == {"unknown status", "value outside [0, 1]"}
    assert got[5] == {"kind without value"}


def test_statistics_ignore_order_and_exclusions(spark):
    p = pairs(spark, {(True, True): 5, (True, False): 3}).withColumn("status", F.lit("ok"))
    more = p.unionByName(p.limit(2).withColumn("status", F.lit("timeout"))).repartition(7)
    a, b = (A.agreement(P.comparable(x), "a", "b", (False, True)).first() for x in (p, more))
    assert (a.n, a.ac1) == (b.n, b.ac1)


def test_multiset(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "v string") for s in ("aab", "abb"))
    r = M.multiset_difference(a, b).first()
    assert (r.only_a, r.only_b, r.identical) == (1, 1, False)


def test_apportion_zero_total(spark):
    w = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "k string, w double")
    assert [r.alloc for r in sampling.apportion(w, "k", "w", 10).collect()] == [0, 0]


def test_verdict_blocks(spark):
    e = spark.createDataFrame([("x",)], "ref string")
    blocked = spark.createDataFrame([("i", " blocker: no labels")], "item string, reason string")
    assert report.verdict(e, e, blocked).first().verdict == "NOT VERIFIED"
    assert report.exit_code(report.verdict(e, e, blocked.where("false"))) == 0


def test_bisection():
    rate = simulate.match_rate_for_ac1(0.7, 0.8)
    assert simulate.binary_ac1(0.8, 0.8, rate) == pytest.approx(0.7, abs=1e-6)


def test_tar_members(spark):
    assert tar.demo_shards(spark).count() == 5


def test_resume():
    assert [log.resume_decision(n, 5, 5) for n in (0, 2, 5)] == ["fresh", "resume", "done"]
    with pytest.raises(ValueError):
        log.resume_decision(2, 5, 6)


def test_stream_resumes(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    row = lambda f, s: (f, "j", "1", "P0", None, None, None, "", s, 1, 0.0)
    late = ("a", "j", "1", "P0", None, None, None, "", "refused", 2, 0.0)
    for rows in ([late, row("a", "timeout"), row("b", "error")], [row("a", "ok"), row("c", "error")]):
        spark.createDataFrame(rows, schemas.RESPONSE).coalesce(1).write.mode("append").json(folder)
        log.keep_first(log.responses(spark, folder), out, mark, "latency_ms").awaitTermination()
    got = {r.frame_id: r.status for r in spark.read.parquet(out).collect()}
    assert got == {"a": "timeout", "b": "error", "c": "error"}


def test_ranks_are_not_made_in_one_task(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        atlas = M.thumbnails(rows, "k", 10, 5)
        assert max(len(x) for x in atlas.rdd.glom().collect()) < 1000
        assert sorted(map(tuple, atlas.collect())) == [(i, i % 32 * 10, i // 32 * 5) for i in range(1000)]
        members = rows.select(F.col("k").alias("frame_id"), (F.col("k") + 1).alias("position"))
        reserve = members.withColumn("frame_id", F.col("frame_id") + 5000)
        fixed = sampling.replace_undecodable(members, reserve, F.col("frame_id") % 2 == 0)
        assert sorted(r.frame_id for r in fixed.where("frame_id >= 5000").collect()) == list(range(5000, 5500))
        assert [r.k for r in sampling.ranked(spark.createDataFrame([("b",), (None,), ("a",)], "k string"), "k", "r").orderBy("r").collect()] == [None, "a", "b"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_judge_errors_are_records(spark):
    def ask(texts):
        if texts.str.contains("broken").any():
            raise ValueError("cannot read")
        return pd.DataFrame({"hands_visible": texts.str.len(), "manipulation": texts == "a", "raw": texts})

    rows = spark.createDataFrame([(1, "a"), (2, "broken"), (3, "bb")], "frame_id long, text string").coalesce(1)
    got = {r.frame_id: (r.hands_visible, r.manipulation, r.status, r.raw) for r in judging.judge_frames(rows, "D", "1", "P0", ask, "text").collect()}
    assert got == {1: (1, True, "ok", "a"), 2: (None, None, "error", "ValueError: cannot read"), 3: (2, False, "ok", "bb")}
    assert judging.judge_frames(rows.where("false"), "D", "1", "P0", ask, "text").count() == 0


def test_tar_walk_ends_at_a_bad_header():
    head = bytearray(512)
    head[:1], head[124:135], head[156:157] = b"a", b"00000000001", b"0"
    bad = bytearray(head)
    bad[124:135] = b"0000000009x"
    whole = bytes(head) + b"x" + bytes(511) + bytes(bad)
    assert list(tar.members(lambda at, n: whole[at : at + n])) == [("a", 512, 1)]


def test_frames(spark):
    arm = spark.createDataFrame([(1,), (2,)], "frame_id long")
    labels = spark.createDataFrame([(1, 2, True), (2, 0, False), (3, 1, True)], "frame_id long, hands int, manip boolean")
    answers = spark.createDataFrame([(1, 0)], "frame_id long, hands_visible int")
    assert sorted(map(tuple, frames.vendor_arm(answers, labels, arm, "v", "hands", "manip").collect())) == [(1, 0), (2, 0)]
    shape = frames.vendor_response(labels, "v", "hands", "manip").where("frame_id = 1").first()
    assert (shape.raw, shape.status, shape.confidence.kind, shape.judge_rev) == ("2\n---\nyes", "ok", "none", "unknown")
    failed = frames.extraction_failures(arm, "A", F.lit("E"), F.repeat(F.lit("x"), 5000)).first()
    assert (len(failed.raw), failed.status, failed.hands_visible) == (2000, "error", None)
    assert frames.next_frame(arm, arm, "n").count() == 0
    tags = spark.range(1).select(frames.closed_tags(F.lit("## Tags\n\n`a-b`,\n`c`\n\nRule: tag `c`, Tagged\n`x`"), "## Tags").alias("c"), frames.referenced_tags(F.lit("tag `c`, Tagged\n`x`, `y`")).alias("r")).first()
    assert (tags.c, tags.r) == (["a-b", "c"], ["c", "x"])
    fig = spark.range(1).select(*[frames.figure(F.lit('{"a": {"b": [0.12345, 12345]}}'), p, f).alias(f) for p, f in (("a.b.0", "pct1"), ("a.b.0", "ratio3"), ("a.b.1", "int_comma"), ("a.b.1", "raw_int"))]).first()
    assert tuple(fig) == ("12.3", "0.123", "12,345", "12345")


def test_binomial_draws(spark):
    from math import comb

    grid = [(u, n, p) for p in (0.03, 0.5, 0.9) for n in (1, 7, 40, 300) for u in (0.0001, 0.2, 0.5, 0.77, 0.9999)]
    for p in (0.03, 0.5, 0.9):
        mine = [(u, n) for u, n, q in grid if q == p]
        got = spark.createDataFrame(mine, "u double, n long").select("u", "n", X.binomial(F.col("u"), F.col("n"), p).alias("k")).collect()
        for r in got:
            total = 0.0
            for k in range(r.n + 1):
                total += comb(r.n, k) * p**k * (1 - p) ** (r.n - k)
                if total >= r.u:
                    break
            assert r.k == k
    cells = spark.createDataFrame([("a", 10), ("b", 30), ("c", 60)], "v string, k long")
    drawn = resample.cell_draws(cells, ["v"], "k", "t", 2000)
    assert {r.n for r in drawn.groupBy("b").agg(F.sum("_drawn").alias("n")).collect()} == {100}
    assert {r.v: round(r.m) for r in drawn.groupBy("v").agg((F.sum("_drawn") / 2000).alias("m")).collect()} == {"a": 10, "b": 30, "c": 60}
    assert resample.cell_draws(cells.where("false"), ["v"], "k", "t", 5).count() == 0
