"""Prompt edits, task values, printed tables, result documents."""

import pytest
from pyspark.sql import functions as F

from assayer.functions import scalars as X
from assayer.functions import schemas
from assayer.operators import report
from assayer.sources import readers, sinks


def test_edits_are_literal_and_in_turn(spark):
    edits = "array(named_struct('find', 'a.b', 'put', 'x'), named_struct('find', 'x', 'put', ''), named_struct('find', '', 'put', '!'), named_struct('find', 'zz', 'put', 'z'))"
    rows = spark.createDataFrame([("a.b acb xx zzzz",), ("",), (None,)], "t string").select(X.edited_by(F.col("t"), F.expr(edits)).alias("by"), X.edited(F.col("t"), [("a.b", "x"), ("x", ""), ("zz", "z")]).alias("plain")).collect()
    assert [tuple(r) for r in rows] == [(" acb  zz", " acb  zz"), ("", ""), (None, None)]


def test_unknown_tasks_raise(spark):
    rows = spark.createDataFrame([("hands_ge_1", 1, None), ("hands_eq_2", None, True), ("manipulation", 0, True)], "task string, h int, m boolean")
    value = X.task_value(F.col("task"), F.col("h"), F.col("m")).alias("v")
    assert [r.v for r in rows.select(value).collect()] == [True, None, True]
    with pytest.raises(Exception, match="unknown task: grasp"):
        rows.withColumn("task", F.lit("grasp")).select(value).collect()


def test_log_probabilities(spark):
    rows = spark.createDataFrame([([],), ([0.0],), ([-1.0, -3.0],), ([2.0],), (None,)], "lp array<double>").select(X.logprob_confidence(F.col("lp")).alias("c")).collect()
    assert [(r.c.kind, r.c.value and round(r.c.value, 6)) for r in rows] == [("none", None), ("logprob", 1.0), ("logprob", 0.135335), ("none", None), ("none", None)]


def test_tables_leave_out_what_is_not_there(spark):
    a = spark.createDataFrame([("en", 0.5, None)], "label string, published double, judge double")
    rows = report.figure_tables(a, a.where("false"), a).collect()
    assert sorted(tuple(r) for r in rows) == [("prevalence", "en", "published", 0.5), ("vendor", "en", "published", 0.5)]


def test_a_document_is_one_array(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.createDataFrame([("b", 2), ("a", None)], "frame_id string, frame_index long")
    sinks.write_document(rows, path)
    assert [(r.frame_id, r.frame_index) for r in readers.json_records(spark, path, schemas.FRAME).collect()] == [("a", None), ("b", 2)]
    (tmp_path / "bad.json").write_text('[{"frame_id": 1, "frame_index": "x"}]')
    with pytest.raises(Exception, match="[Mm]alformed"):
        readers.json_records(spark, str(tmp_path / "bad.json"), schemas.FRAME).collect()
