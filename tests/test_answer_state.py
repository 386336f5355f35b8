"""The keyed state of the answer log: kept by Spark's own aggregation, and a winner is never replaced."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

from assayer.streaming import log, state

SCHEMA = "frame_id string, prompt_variant string, arrived long, cost double"


def measures():
    return {"n_ok": F.lit(True), "positive": F.lit(False), "cost": F.col("cost"), "latency": F.lit(1)}


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).parquet(folder)


def tracked(spark, stream, mark, on_batch=None):
    query = state.track(stream, mark, "arrived", measures(), on_batch=on_batch)
    query.awaitTermination()
    return query


def test_one_operator_without_python_keeps_winners_counts_and_sums(spark, tmp_path):
    stream, mark = put(spark, str(tmp_path / "in"), [(f"f{i % 50}", f"P{i % 2}", i, 1.0) for i in range(400)]), str(tmp_path / "mark")
    operators = tracked(spark, stream, mark).lastProgress["stateOperators"]
    assert [(o["operatorName"], o["numRowsTotal"]) for o in operators] == [("stateStoreSave", 50)]
    assert {r.prompt_variant: (r.n, r.cost) for r in state.rates(spark, mark).collect()} == {"P0": (25, 25.0), "P1": (25, 25.0)}
    assert {r.seen for r in state.arrivals(spark, mark).collect()} == {8}


def test_a_later_batch_does_not_replace_a_winner_by_an_earlier_arrival(spark, tmp_path):
    folder, mark, new = str(tmp_path / "in"), str(tmp_path / "mark"), []
    keep = lambda batch, _: new.append({tuple(r) for r in state.found(batch).select("frame_id", "arrived").collect()})
    tracked(spark, put(spark, folder, [("a", "P", 9, 1.0), ("a", "P", 7, 2.0), (None, "P", 8, 4.0)]), mark, keep)
    tracked(spark, put(spark, folder, [("a", "P", 1, 8.0), ("b", "P", 2, 16.0), (None, "P", 1, 32.0)]), mark, keep)
    assert new == [{("a", 7), (None, 8)}, {("b", 2)}]
    assert {(r.frame_id, r.arrived) for r in state.winners(spark, mark).collect()} == {("a", 7), (None, 8), ("b", 2)}
    assert [(r.n, r.cost) for r in state.rates(spark, mark).collect()] == [(3, 22.0)]


def test_only_new_winners_are_appended(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for rows in ([("a", "P", 5, 1.0)], [("a", "P", 1, 2.0)], [("a", "P", 2, 3.0), ("b", "P", 6, 4.0)]):
        log.keep_first(put(spark, folder, rows), out, mark, "arrived").awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r.frame_id, r.arrived) for r in got.collect()) == [("a", 5), ("b", 6)]
    assert [c for c in got.columns if c != "batch"] == ["frame_id", "prompt_variant", "arrived", "cost"]


def test_a_clock_behind_an_earlier_batch_raises(spark, tmp_path):
    folder, mark = str(tmp_path / "in"), tmp_path / "mark"
    for i in (5, 1):
        tracked(spark, put(spark, folder, [("a", "P", i, 1.0)]), str(mark))
    # The second batch as a run leaves it that stopped within it, on a machine whose clock was behind.
    for name in ("commits/1", "commits/.1.crc", "offsets/.1.crc"):
        pathlib.Path(mark, name).unlink(missing_ok=True)
    offsets = mark / "offsets" / "1"
    offsets.write_text(re.sub(r'"batchTimestampMs":\d+', '"batchTimestampMs":1000', offsets.read_text()))
    with pytest.raises(Exception, match="clock is behind"):
        tracked(spark, put(spark, folder, [("b", "P", 9, 1.0)]), str(mark))
    assert [r.arrived for r in state.winners(spark, str(mark)).collect()] == [5]
