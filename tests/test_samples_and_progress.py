"""The sample graph, gold halves, review sets, guarded runs and their progress, assembled intervals, and thresholds that must be there."""

import time

import pytest
from pyspark.sql import functions as F

from assayer.operators import calibration, reliability, sensitivity
from assayer.operators import sample_graph as G
from assayer.operators.multinomial import ac1_intervals
from assayer.streaming import progress as P


def pool(spark, n, first=0):
    return spark.range(first, first + n).withColumnRenamed("id", "frame_id")


def outcomes(df):
    return {r.sample: (r.outcome, r.n, r.reason) for r in df.collect()}


def test_graph_draws_in_order_and_rewrites_what_changed(spark, tmp_path):
    path = str(tmp_path / "members")
    graph = [G.Sample("child", 5, parents=("root",)), G.Sample("root", 20, pool="a"), G.Sample("other", 3, "all", pool="a"), G.Sample("lost", 3, pool="b"), G.Sample("below", 3, parents=("lost", "root"))]
    first = outcomes(G.draw(spark, {"a": pool(spark, 50)}, graph, path))
    assert first == {"root": ("drawn", 20, None), "child": ("drawn", 5, None), "other": ("drawn", 3, None), "lost": ("skipped", None, "pool b is not there"), "below": ("skipped", None, "sample lost is not there")}
    root, child = ({r.frame_id for r in G.members(spark, path, s).collect()} for s in ("root", "child"))
    assert child < root and len(root) == 20 and {r.frame_id for r in G.members(spark, path, "other").collect()} == {0, 1, 2}
    assert {o for o, _, _ in outcomes(G.draw(spark, {"a": pool(spark, 50)}, graph, path)).values()} == {"unchanged", "skipped"}
    files = {f for f in spark.read.parquet(path).inputFiles() if "sample=other" in f}
    again = outcomes(G.draw(spark, {"a": pool(spark, 60), "b": pool(spark, 9)}, graph, path))
    assert again["root"][0] == "drawn" and again["other"][0] == "unchanged" and again["below"] == ("drawn", 3, None)
    assert files == {f for f in spark.read.parquet(path).inputFiles() if "sample=other" in f}


def test_graphs_that_cannot_be(spark, tmp_path):
    for bad, why in (([G.Sample("a", 1, parents=("b",)), G.Sample("b", 1, parents=("a",))], "depend on each other: a -> b -> a"), ([G.Sample("a", 1, parents=("z",))], "unknown parent: z"), ([G.Sample("a", 1), G.Sample("a", 2)], "named twice")):
        with pytest.raises(ValueError, match=why):
            G.order(bad)
    path = str(tmp_path / "members")
    pool(spark, 3).union(pool(spark, 1)).withColumn("sample", F.lit("root")).write.partitionBy("sample").parquet(path)
    with pytest.raises(ValueError, match="1 ids that are null or twice"):
        G.checked(G.members(spark, path, "root"), "frame_id")
    assert G.members(spark, path, "none") is None and G.members(spark, str(tmp_path / "nowhere"), "root") is None


def test_halves_and_review_sets(spark):
    for n in (0, 1, 7, 40):
        parts = [r.part for r in G.gold_halves(pool(spark, n), "x").collect()]
        assert parts.count("calibration") == n // 2 and len(parts) == n
    judged = pool(spark, 30).withColumn("differs", F.col("frame_id") < 6)
    rows = G.review_set(judged, "differs", "r", 0.5).collect()
    assert sorted(r.position for r in rows) == list(range(1, 10)) and sum(r.arm == "control" for r in rows) == 3
    assert {r.frame_id for r in rows if r.arm == "disagreement"} == set(range(6))
    assert G.review_set(judged, "differs", "r", 100).count() == 30 and G.review_set(judged.where("false"), "differs", "r", 1).count() == 0


def test_a_run_is_entered_once_and_resumed_as_it_was(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    assert P.enter(spark, ledger, "r", {"variant": "P0", "b": 1}, 100) == "fresh"
    assert P.enter(spark, ledger, "r", {"b": 1, "variant": "P0"}, 100) == "resume"
    assert P.enter(spark, ledger, "s", {"variant": "P1"}, 5) == "fresh"
    with pytest.raises(ValueError, match="over 100 records, not 20"):
        P.enter(spark, ledger, "r", {"variant": "P0", "b": 1}, 20)
    with pytest.raises(ValueError, match="with .*P0"):
        P.enter(spark, ledger, "r", {"variant": "P1", "b": 1}, 100)


def test_progress_is_a_table(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "progress")
    assert P.progress(spark, table).count() == 0
    listener = P.ProgressTable(spark, table, "run-a")
    spark.streams.addListener(listener)

    def run(name, fail=False):
        def sink(batch, i):
            batch.write.format("noop").mode("overwrite").save()
            if fail:
                raise RuntimeError("stopped here")

        stream = spark.readStream.schema("frame_id long").option("maxFilesPerTrigger", 1).parquet(folder)
        stream.writeStream.queryName(name).foreachBatch(sink).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()

    def rows(n):
        for _ in range(100):
            got = P.progress(spark, table).orderBy("n_in_total").collect()
            if len(got) >= n:
                break
            time.sleep(0.2)
        return got

    try:
        for _ in range(2):
            pool(spark, 10).coalesce(1).write.mode("append").parquet(folder)
        run("run-a")
        assert [(r.run, r.n_in, r.n_in_total, r.error) for r in rows(2)] == [("run-a", 10, 10, None), ("run-a", 10, 20, None)]
        run("another")
        pool(spark, 5).coalesce(1).write.mode("append").parquet(folder)
        with pytest.raises(Exception, match="stopped here"):
            run("run-a", fail=True)
        last = rows(3)
        assert len(last) == 3 and any(r.error for r in last)
    finally:
        spark.streams.removeListener(listener)


def test_intervals_of_agreement(spark):
    rows = [("x", i % 2 == 0, i % 4 != 1, f"c{(i % 4 != 1) * 2 + i % 3}", "ok") for i in range(200)] + [("x", None, True, "c0", "refused"), ("y", True, True, "c1", "ok")]
    pairs = spark.createDataFrame(rows, "judge string, a boolean, b boolean, cluster string, status string")
    got = {r.judge: r for r in reliability.assembled_in_full(pairs, "a", "b", (False, True), "cluster", "judge", 400).collect()}
    x = got["x"]
    assert x.n == 200 and x.n_excluded == 1 and x.ac1_lo < x.ac1 < x.ac1_hi and x.clusters == 5 and x.design_effect > 1
    assert got["y"].n == 1 and got["y"].design_effect is None and got["y"].ac1_lo == got["y"].ac1_hi
    assert ac1_intervals(pairs.where("false"), "a", "b", (False, True), ["judge"], 50).count() == 0


def test_summary_of_nothing_comparable(spark):
    r = spark.createDataFrame([(1, "refused", None, None, 0.5, 7), (2, "ok", 2, True, None, None)], "frame_id long, status string, hands_visible int, manipulation boolean, cost_usd double, latency_ms long").withColumn("v", F.lit("P0"))
    labels = spark.createDataFrame([(1, 0, True)], "frame_id long, hand_count int, active_labor boolean")
    s = sensitivity.run_summary(r, labels, "v").first()
    assert (s.n, s.n_ok, s.n_comparable, s.hands_agreement, s.labor_agreement, s.cost_usd, s.latency_ms, s.status_counts) == (2, 1, 0, 0.0, 0.0, 0.5, 7, {"ok": 1, "refused": 1})


def test_a_floor_out_of_reach_raises(spark):
    rows = spark.createDataFrame([(i, 0.9, i % 2 == 0) for i in range(50)], "frame_id long, conf double, right boolean")
    with pytest.raises(Exception, match="no threshold reaches the floor of 0.8"):
        calibration.required_threshold(rows, "conf", "right", "frame_id").collect()
    assert calibration.required_threshold(rows.withColumn("right", F.lit(True)), "conf", "right", "frame_id").first().answered == 50
