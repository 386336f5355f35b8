"""The append-only response log as a stream: first answer wins, running rates, resume by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import schemas
from assayer.streaming.state import KEYS, first_answers, found, keyed_state


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """The log's folder of JSON lines as a stream."""
    return spark.readStream.schema(schemas.RESPONSE).option("mode", "FAILFAST").json(folder)


def keep_first(stream: DataFrame, path: str, checkpoint: str, arrival: str, keys: list[str] = KEYS):
    """Append the first answer of each key, by arrival within a batch and by batch, to a folder per batch, and stop when
    all that is new is read. Which keys are taken is keyed state; a batch that is run again replaces its own folder, so
    a resumed run neither repeats nor loses a key and no batch reads what earlier ones wrote."""

    def append(batch: DataFrame, batch_id: int) -> None:
        found(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with keyed_state(stream.sparkSession):
        return first_answers(stream, arrival, keys).writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_rates(stream: DataFrame) -> DataFrame:
    """n_ok, positives and statuses by variant so far (output mode complete)."""
    ok = F.col("status") == "ok"
    return stream.groupBy("prompt_variant").agg(F.count_if(ok).alias("n_ok"), F.count_if(ok & F.col("manipulation")).alias("positive"), F.count(F.lit(1)).alias("n"))


def write_once(stream: DataFrame, path: str, checkpoint: str):
    """Process what is new since the checkpoint and stop: a resumed run neither repeats nor loses a record."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def not_done(work: DataFrame, sink: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The work whose result the sink does not hold yet."""
    return work.join(sink.select(*keys).distinct(), keys, "left_anti")


def resume_decision(n_done: int, n_total: int, n_total_before: int | None) -> str:
    """fresh, resume or done; a run over another total must not be continued."""
    if n_total_before is not None and n_total_before != n_total:
        raise ValueError(f"the log is of a run over {n_total_before} records, not {n_total}")
    return "fresh" if not n_done else "done" if n_done >= n_total else "resume"
