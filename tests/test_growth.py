"""Steps that must not fail or gather in one task as tables grow."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer import catalog
from assayer.operators import agreement as A
from assayer.operators import multinomial as T
from assayer.operators import prevalence as V
from assayer.plans import coverage_queries, source_queries, standins


def test_error_dependence_of_many_frames(spark):
    """Products of four counts that do not fit 64 bits."""
    n = 240_000
    truth = spark.range(n).select(F.col("id").alias("frame_id"), F.lit(True).alias("truth"))
    judges = F.explode(F.array(F.struct(F.lit("A").alias("judge"), (F.col("id") % 2 == 0).alias("said")), F.struct(F.lit("B").alias("judge"), (F.col("id") % 4 < 3).alias("said"))))
    answers = spark.range(n).select(F.col("id").alias("frame_id"), judges.alias("j"), F.lit("ok").alias("status")).select("frame_id", "status", "j.*")
    row = A.error_dependence(truth, answers, "truth", "said").first()
    assert row.n_pairs == 1
    assert abs(row.phi - 3**-0.5) < 1e-12  # n11 = n/4, n1 = n/2, m1 = n/4


def test_evaluation_rows_are_stored_by_ranges(spark, tmp_path):
    """No task takes the whole table, and a row's place counts through all files."""
    spark.range(3000).select(((F.col("id") * 1117) % 3001).alias("doc_id"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), 500)).otherwise("").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = coverage_queries.evaluation_rows(spark, str(tmp_path))
        got = sorted((r.frame_index, r.frame_id) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    rows = sorted((i * 1117 % 3001, i % 7 > 0) for i in range(3000))
    assert got == [(place, f"f{doc}") for place, (doc, text) in enumerate(rows) if text and doc % 11]
    stored = spark.read.parquet(found.inputFiles()[0].rsplit("/", 1)[0])
    sizes = [r["count"] for r in stored.groupBy("_metadata.file_name").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1500


def test_judges_are_asked_where_their_frames_lie(spark, tmp_path):
    """The number of tasks that ask grows with the table."""
    spark.range(60).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars")).repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        got = source_queries.judge_retries(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() == 12 and got.count() == 60
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_letters_of_odd_texts(spark, tmp_path):
    """Counted without naming what is no letter: marks, digits, other scripts and pairs of surrogates."""
    texts = ["Abc é×÷ÿ.", "1234", "日本 x", "\U0001f600a!", "a\n\tb", "Ā", "." * 400]
    rows = [(i * 31, t, "en", "s", len(t)) for i, t in enumerate(texts, 1000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = standins.responses(spark, str(tmp_path)).where("judge = 'A' and status = 'ok'")
    share = lambda t: len(re.findall("[A-Za-zÀ-ÿ ]", t)) / len(t)
    want = {i: (share(t) > 0.9, 2 if share(t) > 0.97 else int(share(t) > 0.9)) for i, t, *_ in rows if i % 23 and i % 29 and i % 31}
    assert {r.frame_id: (r.manip, r.hands) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "[^" not in plan


@pytest.mark.parametrize("name", ["figure_tables", "prevalence_ppi_plus", "gold_and_unlabelled", "prevalence_ppi_clustered", "assembled_in_full", "run_summary", "design_effects_by_task"])
def test_texts_are_judged_once(spark, name):
    """A query that looks at its answers again does not read the texts again."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 1


def test_moments_in_one_pass(spark):
    rows = [("x", i % 3 == 0, i % 5 == 0, i % 4 > 0) for i in range(40)] + [("labels only", True, True, True), ("answers only", True, False, False), ("x", None, True, True)]
    r = spark.createDataFrame(rows, "arm string, y boolean, f boolean, there boolean")
    want = V.moments(r.where("there"), r.where("not there"), "y", "f", "arm").collect()
    got = V.moments_by_presence(r, "y", "f", "there", "arm").collect()
    assert [w.arm for w in want] == [g.arm for g in got] == ["x"]
    assert got[0][1:] == pytest.approx(want[0][1:])


def test_draws_are_made_in_blocks_and_do_not_depend_on_them(monkeypatch):
    sizes, draw = [], T.binomial
    monkeypatch.setattr(T, "binomial", lambda n, p, key: sizes.append(len(n)) or draw(n, p, key))
    w, draws = np.arange(4096) % 700, np.full(256, 60_000)
    got = T.split(w, draws, 8192, 12, 7)
    assert max(sizes) <= T._BLOCK and (got.sum(axis=1) == 60_000).all() and not got[:, w == 0].any()
    monkeypatch.setattr(T, "_BLOCK", 1 << 30)
    assert (T.split(w, draws, 8192, 12, 7) == got).all()


def test_nodes_of_a_tree_are_dealt_by_number(spark):
    """Cells of few bytes are still split by as many tasks as there are partitions."""
    cells = spark.range(40_000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("k"))
    sums = T.resample_sums(cells.withColumn("x", F.col("v")), [], ["v"], "k", ["x"], 3)
    sums.collect()
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "hashpartitioning(_group" in plan
    assert T.resample_sums(cells.where("v < 9"), [], ["v"], "k", ["v"], 3).count() == 3
