"""Runs that say how far they are: a progress table, and a ledger that keeps a run from going on under another configuration."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "run string, query string, batch long, at string, n_in long, n_in_total long, rows_a_second double, error string"
LEDGER = "run string, digest string, n_total long, config string"


class ProgressTable(StreamingQueryListener):
    """Appends a row for each batch of the queries named after a run, and one with the error for a run that fails."""

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run, self.total, self.ids = spark, path, run, 0, set()

    def _append(self, *row) -> None:
        self.spark.createDataFrame([(self.run, *row)], PROGRESS).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.run:
            self.ids.add(str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if str(p.id) in self.ids and p.numInputRows:
            self.total += p.numInputRows
            self._append(str(p.id), p.batchId, p.timestamp, p.numInputRows, self.total, p.processedRowsPerSecond, None)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.id) in self.ids and event.exception:
            self._append(str(event.id), None, None, None, self.total, None, event.exception.splitlines()[0][:500])


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The rows so far; none before the first batch."""
    try:
        return spark.read.schema(PROGRESS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], PROGRESS)


def digest(config: dict, n_total: int) -> str:
    return hashlib.sha256(json.dumps([config, n_total], sort_keys=True, default=str).encode()).hexdigest()


def enter(spark: SparkSession, ledger: str, run: str, config: dict, n_total: int) -> str:
    """fresh for a run that the ledger does not know, which it then does, resume for one it knows. A known run under another configuration or over another total raises."""
    mine = digest(config, n_total)
    try:
        known = [r for r in spark.read.schema(LEDGER).parquet(ledger).where(F.col("run") == run).collect()]
    except AnalysisException:
        known = []
    if any(r["digest"] != mine for r in known):
        other = next(r for r in known if r["digest"] != mine)
        what = f"over {other['n_total']} records, not {n_total}" if other["n_total"] != n_total else f"with {other['config']}"
        raise ValueError(f"run {run} began {what}")
    if known:
        return "resume"
    spark.createDataFrame([(run, mine, n_total, json.dumps(config, sort_keys=True, default=str))], LEDGER).write.mode("append").parquet(ledger)
    return "fresh"
