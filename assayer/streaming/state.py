"""The response log as keyed state: first answer wins, running rates, both recovered from the state store.

One streaming aggregation, keyed by (frame, variant). Its state is the winning
record, how many answers arrived and when the last batch with one began. What
orders records is the time at which their batch began and then `arrival`, so a
winner that an earlier batch left is never replaced. Spark writes the time of a
batch down before the batch runs, and a batch that runs again has the same one;
where the clock is behind an earlier batch that met the same key, it raises.
Rates are sums over the winners in the state. Nothing reads the output of
earlier batches: what a batch needs is in the state of its keys, and a run that
stops between or within batches goes on from the state it committed.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources.shared import shared_folder

KEYS = ["frame_id", "prompt_variant"]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUMS = ("n", "n_ok", "positive", "cost", "latency")


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB: it lies on disk, however many keys there are."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def first_answers(stream: DataFrame, arrival: str, keys: list[str] = KEYS) -> DataFrame:
    """keys, first (`at`, when its batch began, `order` and `record`), seen, last: the keys that a batch met, as they are after it.

    The first answer of a key is that of the earliest batch, and within it the one of the least `arrival`."""
    answer = F.struct(F.col("_at").alias("at"), F.col(arrival).alias("order"), F.struct(*stream.columns).alias("record"))
    answers = stream.withColumn("_at", F.current_timestamp())
    met = answers.groupBy(*keys).agg(F.min(answer).alias("first"), F.count(F.lit(1)).alias("seen"), F.max("_at").alias("last"))
    behind = F.raise_error(F.lit("the clock is behind an earlier batch")).cast("timestamp")
    return met.withColumn("last", F.when(F.col("last") > F.current_timestamp(), behind).otherwise(F.col("last")))


def found(batch: DataFrame) -> DataFrame:
    """Of what first_answers wrote in a batch, the winners that this batch found."""
    return batch.where(F.col("first.at") == F.col("last")).select("first.record.*")


def track(stream: DataFrame, checkpoint: str, arrival: str, measures: dict[str, Column], keys: list[str] = KEYS, on_batch=None):
    """Start a query over all that is new in the log and stop after it. measures names a column for each of SUMS but n.

    on_batch(rows, batch id), if given, is called with what a batch wrote; an error there leaves the batch uncommitted."""
    columns = {f"_{m}": measures[m] for m in SUMS[1:]} | {"_n": F.lit(1).cast("long")}
    log = stream.withColumns({c: columns[c].cast("double" if c in ("_cost", "_latency") else "long") for c in columns}).fillna(0, list(columns))
    with keyed_state(stream.sparkSession):
        writer = first_answers(log, arrival, keys).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return (writer.foreachBatch(on_batch) if on_batch else writer.format("noop")).start()


def _state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, first, seen: the state that the last committed batch left; its columns have the names of the aggregates."""
    with keyed_state(spark):
        return spark.read.format("statestore").load(checkpoint).select("key", F.col("value.min").alias("first"), F.col("value.count").alias("seen"))


def winners(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The winning records, from the state that the last committed batch left."""
    return _state(spark, checkpoint).select("first.record.*").drop(*[f"_{c}" for c in SUMS])


def arrivals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Each key and how many answers arrived for it, those after the first included."""
    return _state(spark, checkpoint).select("key.*", "seen")


def rates(spark: SparkSession, checkpoint: str) -> DataFrame:
    """prompt_variant and the sums of its winners so far."""
    rows = _state(spark, checkpoint)
    variant = rows.schema["key"].dataType.names[-1]
    return rows.groupBy(F.col(f"key.`{variant}`").alias(variant)).agg(*[F.sum(f"first.record._{c}").alias(c) for c in SUMS])


def finished(totals: DataFrame, per_variant: int) -> DataFrame:
    """The variants that have a winner for each of per_variant frames; more than that raises when read."""
    other = F.raise_error(F.lit("the log holds frames of another run")).cast("boolean")
    return totals.where(F.when(F.col("n") > per_variant, other).otherwise(F.col("n") == per_variant)).select("prompt_variant")


def finished_only(log: DataFrame, totals: DataFrame, per_variant: int) -> DataFrame:
    """The log without the variants that a resumed run does again from their start."""
    return log.join(finished(totals, per_variant), "prompt_variant", "left_semi")


def remaining(work: DataFrame, won: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The work that has no winner yet, at whatever point of a batch the run before stopped."""
    return work.join(won.select(*keys), keys, "left_anti")


def replay(log: DataFrame, arrival: str, measures: dict[str, Column], marks: list[float] | None = None) -> str:
    """The log, arriving in parts that start at marks (thirds by default), each tracked by a run that resumes the one
    before; the checkpoint with the state."""
    spark = log.sparkSession
    base = shared_folder(spark, "stream-state")
    marks = log.stat.approxQuantile(arrival, [1 / 3, 2 / 3], 0.01) if marks is None else marks
    part = sum(((F.col(arrival) >= m).cast("int") for m in marks), F.lit(0))
    for i in range(len(marks) + 1):
        log.where(part == i).write.mode("append").parquet(f"{base}/in")
        track(spark.readStream.schema(log.schema).parquet(f"{base}/in"), f"{base}/checkpoint", arrival, measures).awaitTermination()
    return f"{base}/checkpoint"
