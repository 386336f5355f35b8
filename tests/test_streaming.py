"""The response log as keyed state: stops between and within batches, duplicates, and what resumed runs find."""

import pytest
from pyspark.sql import functions as F

from assayer.streaming import state

SCHEMA = "frame_id string, prompt_variant string, arrived long, ok boolean, cost double"


def measures():
    return {"n_ok": F.col("ok"), "positive": F.col("ok") & (F.col("cost") > 1), "cost": F.col("cost"), "latency": F.lit(10)}


def log_of(n, frames=7):
    return [(f"f{(i * 5) % frames}", f"P{i % 3}", i, None if i % 11 == 0 else i % 4 != 0, float(i % 5)) for i in range(n)]


def firsts(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[2]):
        out.setdefault(r[:2], r)
    return out


def sums(rows):
    out = {}
    for (_, v), r in firsts(rows).items():
        n, ok, positive, cost, latency = out.get(v, (0, 0, 0, 0.0, 0.0))
        out[v] = (n + 1, ok + bool(r[3]), positive + bool(r[3] and r[4] > 1), cost + r[4], latency + 10)
    return out


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def check(spark, mark, rows):
    assert {(r.frame_id, r.prompt_variant): r.arrived for r in state.winners(spark, mark).collect()} == {k: r[2] for k, r in firsts(rows).items()}
    assert {r.prompt_variant: (r.n, r.n_ok, r.positive, r.cost, r.latency) for r in state.rates(spark, mark).collect()} == sums(rows)
    seen = {(r.frame_id, r.prompt_variant): r.seen for r in state.arrivals(spark, mark).collect()}
    assert sum(seen.values()) == len(rows) and all(n == sum(r[:2] == k for r in rows) for k, n in seen.items())


def test_a_batch_that_fails_is_counted_once(spark, tmp_path):
    rows, folder, mark = log_of(60), str(tmp_path / "in"), str(tmp_path / "mark")
    for i in range(3):
        put(spark, folder, rows[i * 20 : i * 20 + 20], f"part{i}")
    reached = []

    def stop_at_second(batch, batch_id):
        batch.count()
        reached.append(batch_id)
        if batch_id == 1 and reached.count(1) == 1:
            raise RuntimeError("the machine is gone")

    with pytest.raises(Exception, match="the machine is gone"):
        state.track(stream(spark, folder), mark, "arrived", measures(), on_batch=stop_at_second).awaitTermination()
    check(spark, mark, rows[:20])
    state.track(stream(spark, folder), mark, "arrived", measures(), on_batch=stop_at_second).awaitTermination()
    assert reached == [0, 1, 1, 2]
    check(spark, mark, rows)


def test_winners_of_a_growing_log(spark, tmp_path):
    folder, mark, rows = str(tmp_path / "in"), str(tmp_path / "mark"), log_of(30)
    put(spark, folder, rows[:10], "a")
    state.track(stream(spark, folder), mark, "arrived", measures()).awaitTermination()
    check(spark, mark, rows[:10])
    work = spark.createDataFrame([r[:2] for r in rows], "frame_id string, prompt_variant string").distinct()
    assert {tuple(r) for r in state.remaining(work, state.winners(spark, mark)).collect()} == {r[:2] for r in rows} - set(firsts(rows[:10]))
    put(spark, folder, rows[10:], "b")
    state.track(stream(spark, folder), mark, "arrived", measures()).awaitTermination()
    check(spark, mark, rows)
    log = spark.createDataFrame(rows, SCHEMA)
    assert state.finished(state.rates(spark, mark), 7).count() == 3
    assert state.finished_only(log, state.rates(spark, mark).where("prompt_variant <> 'P1'"), 7).where("prompt_variant = 'P1'").isEmpty()
    with pytest.raises(Exception, match="another run"):
        state.finished(state.rates(spark, mark), 6).collect()


def test_a_null_key_is_a_key(spark, tmp_path):
    rows = [(None, "P0", 3, True, 1.0), (None, "P0", 1, True, 2.0), ("", None, 2, None, 3.0)]
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    put(spark, folder, rows, "a")
    state.track(stream(spark, folder), mark, "arrived", measures()).awaitTermination()
    assert sorted((str(r.frame_id), str(r.prompt_variant), r.arrived) for r in state.winners(spark, mark).collect()) == [("", "None", 2), ("None", "P0", 1)]
