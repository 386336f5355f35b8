"""Closed records, the stored row index, pinned figures, retries and slices, on small hostile inputs."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from assayer.functions import records, schemas
from assayer.operators import judging, prose
from assayer.operators.agreement import all_slices
from assayer.sources import row_index

GOOD = {
    "frame_id": "f", "judge": "j", "judge_rev": "1", "prompt_variant": "P0", "hands_visible": 1, "manipulation": True,
    "confidence": {"kind": "none", "value": None}, "raw": "1", "status": "ok", "latency_ms": 5, "cost_usd": 0.5,
}


def faults(spark, *raw, schema=schemas.RESPONSE):
    rows = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(raw)], "i long, raw string")
    got = {r.i: [tuple(f) for f in r.faults] for r in records.record_faults(rows, "raw", schema).collect()}
    return [got[i] for i in range(len(raw))]


def test_faults_by_path(spark):
    nested = GOOD | {"confidence": {"kind": 1, "extra": {}}}
    assert faults(spark, GOOD, dict.fromkeys(GOOD), nested, GOOD | {"b": 1, "a": 2}) == [
        [], [], [("$.confidence.extra", "unknown field"), ("$.confidence.value", "missing field"), ("$.confidence.kind", "wrong type")], [("$.a", "unknown field"), ("$.b", "unknown field")],
    ]
    assert faults(spark, None, "", "{", "[1]", "3", '{"frame_id":"a","frame_id":"b"}') == [[("$", "malformed")]] * 6
    assert faults(spark, {k: v for k, v in GOOD.items() if k != "raw"}) == [[("$.raw", "missing field")]]
    assert faults(spark, GOOD | {"hands_visible": 2**40}, GOOD | {"cost_usd": 1}, GOOD | {"cost_usd": "1"}, GOOD | {"manipulation": 1}) == [[("$.hands_visible", "wrong type")], [], [("$.cost_usd", "wrong type")], [("$.manipulation", "wrong type")]]


def test_labels_have_lists_and_times(spark):
    label = {"frame_id": "f", "rater": "r", "pass": "primary", "rubric_rev": "1", "hands_visible": 0, "manipulation": False, "edge_case": [], "difficulty": "easy", "note": None, "labelled_at": "2024-01-02T03:04:05Z", "seconds_spent": 3}
    bad = label | {"edge_case": [1], "labelled_at": "soon"}
    assert faults(spark, label, label | {"edge_case": ["blur"]}, bad, schema=schemas.LABEL) == [[], [], [("$.edge_case", "wrong type"), ("$.labelled_at", "wrong type")]]
    rows = spark.createDataFrame([(json.dumps(label),), (json.dumps(bad),)], "raw string")
    assert [(r.frame_id, r.hands_visible, r.seconds_spent) for r in records.accepted(rows, "raw", schemas.LABEL).collect()] == [("f", 0, 3)]


@pytest.fixture(scope="module")
def arm(spark, tmp_path_factory):
    data, index = str(tmp_path_factory.mktemp("arm") / "data"), str(tmp_path_factory.mktemp("arm") / "index")
    rows = spark.range(4000).select(F.col("id").alias("frame_id"), F.concat(F.lit("payload "), F.col("id")).alias("payload"), F.lit("a").alias("source_dataset"))
    rows.unionByName(rows.where("frame_id = 17").withColumn("payload", F.lit("a second of 17"))).repartitionByRange(8, "frame_id").write.parquet(data)
    row_index.build_index(spark, data, index, "frame_id", ("source_dataset", "a"))
    return data, index


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "frame_id long")


def test_a_look_up_reads_only_the_files_that_hold_its_ids(spark, arm):
    data, index = arm
    found = row_index.lookup(spark, data, index, ids(spark, [17, 17, 18, 3999, -5, None]), "frame_id", ["payload"])
    got = {r.frame_id: r.payload for r in found.collect()}
    assert set(got) == {17, 18, 3999} and got[3999] == "payload 3999" and got[17] in ("payload 17", "a second of 17")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(frame_id, [" in plan and "file_path" in plan
    assert row_index.files_read(found) <= 3 < len(spark.read.parquet(data).inputFiles())
    assert row_index.lookup(spark, data, index, ids(spark, [-1]), "frame_id", ["payload"]).count() == 0
    assert row_index.lookup(spark, data, index, ids(spark, []), "frame_id", ["payload"]).count() == 0


def test_many_ids_are_bounds(spark, arm, monkeypatch):
    monkeypatch.setattr(row_index, "NAMED", 3)
    got = row_index.lookup(spark, *arm, ids(spark, range(100, 900)), "frame_id", ["payload"]).collect()
    assert sorted(r.frame_id for r in got) == list(range(100, 900)) and all(r.payload == f"payload {r.frame_id}" for r in got)


def test_another_source_or_a_changed_file_raises(spark, arm, tmp_path):
    data, index = arm
    with pytest.raises(Exception, match="source_dataset is not b"):
        row_index.build_index(spark, data, str(tmp_path / "index"), "frame_id", ("source_dataset", "b"))
    other, there = str(tmp_path / "data"), str(tmp_path / "there")
    spark.range(5).withColumnRenamed("id", "frame_id").withColumn("payload", F.lit("x")).coalesce(1).write.parquet(other)
    row_index.build_index(spark, other, there, "frame_id")
    moved = spark.read.parquet(there).withColumn("changed", F.col("changed") - F.expr("INTERVAL 1 DAY"))
    moved.write.parquet(str(tmp_path / "old"))
    with pytest.raises(Exception, match="changed since the index was built"):
        row_index.lookup(spark, other, str(tmp_path / "old"), ids(spark, [1]), "frame_id", ["payload"]).collect()


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "document string, text string"), lambda *pins: spark.createDataFrame(list(pins), "document string, literal string")


def test_cells_and_places(spark):
    text = "né 12.3\n| a | b |\n|---|---:|\n| rate | **80.8** |\n|  other |12.3|-4,500 |\n12.3 | 7 |\n"
    docs, pins = pages(spark, ("d", text), ("e", "| 1 |"), ("f", None))
    cells = sorted((r.document, r.line_number, r.cell, r.start, r.length) for r in prose.numeric_cells(docs).collect())
    raw = text.encode()
    assert cells == [("d", 4, "80.8", raw.index(b"80.8"), 4), ("d", 5, "-4,500", raw.index(b"-4,500"), 6), ("d", 5, "12.3", raw.index(b"|12.3") + 1, 4), ("e", 1, "1", 2, 1)]
    assert sorted(r.start for r in prose.occurrences(docs, pins(("d", "12.3"))).collect()) == [4, raw.index(b"|12.3") + 1, raw.index(b"\n12.3") + 1]
    left = lambda *p, exempt=(): sorted(r.cell for r in prose.unpinned_cells(docs, pins(*p), exempt).collect())
    assert left(("d", "80.8")) == ["-4,500", "12.3"]
    assert left(("d", "80.8"), ("d", "12.3 "), exempt=("-4,500",)) == ["12.3"]
    assert left(("d", "80.8"), ("d", "12.3|-4,500")) == []
    assert left(("d", "8"), ("e", "1")) == ["-4,500", "12.3", "80.8"]
    assert [r.literal for r in prose.missing_literals(docs, pins(("d", "12.3"), ("d", "13"), ("f", "1"), ("g", "1"))).orderBy("literal", "document").collect()] == ["1", "1", "13"]


def test_far_pins_of_a_long_document(spark, monkeypatch):
    monkeypatch.setattr(prose, "BLOCK", 8)
    docs, pins = pages(spark, ("d", "\n".join(f"| r{i} | {i} |" for i in range(1000, 1300)) + "\n| " + "9" * 50 + " |"))
    assert sorted(int(r.cell) for r in prose.unpinned_cells(docs, pins(*[("d", str(i)) for i in range(1000, 1300, 2)], ("d", "9" * 50))).collect()) == list(range(1001, 1300, 2))


def test_retries_and_order(spark):
    transient = judging.TransientError

    def ask(frame, payload):
        if payload == "lost":
            raise transient("down")
        if payload == "bad":
            raise KeyError("bad")
        time.sleep(0.02)
        return {"hands_visible": 1, "manipulation": None, "raw": threading.current_thread().name}

    rows = spark.createDataFrame([(i, {3: "lost", 5: "bad"}.get(i, "x")) for i in range(24)], "frame_id long, payload string").coalesce(1)
    got = judging.judge_with_retries(rows, "j", "1", "P0", ask, "payload", judging.Retry(3, 1.0, 2.0), workers=4, sleep=lambda s: None).collect()
    assert [r.frame_id for r in got] == list(range(24))
    assert tuple(got[3])[6:] == ("timeout", "TransientError: down", 4, 5.0) and tuple(got[5])[6:] == ("error", "KeyError: 'bad'", 1, 0.0)
    assert all(r.status == "ok" and r.attempts == 1 and r.manipulation is None for r in got if r.frame_id not in (3, 5)) and 1 < len({r.raw for r in got if r.status == "ok"}) <= 4
    assert judging.judge_with_retries(rows.where("false"), "j", "1", "P0", ask, "payload").count() == 0
    assert [judging.Retry().delay(i) for i in (0, 1, 3, 4, 5, 400)] == [2, 4, 16, 30, 30, 30]


def test_all_slices_tell_nulls_apart(spark):
    rows = spark.createDataFrame([("x", None, True, True), ("x", "k", True, False), ("y", "k", False, False), ("y", "k", None, True)], "a string, b string, s boolean, t boolean")
    got = {(r.a, r.b, r.level): (r.n, r.tp, r.fp, r.fn, r.tn, r.accuracy) for r in all_slices(rows, "s", "t", "a", "b").collect()}
    assert got[(None, None, 3)] == (3, 1, 1, 0, 1, 2 / 3) and got[("x", None, 0)] == (1, 1, 0, 0, 0, 1.0) and got[("x", None, 1)] == (2, 1, 1, 0, 0, 0.5) and got[(None, None, 2)] == (1, 1, 0, 0, 0, 1.0)
