"""A stored index of the rows of Parquet files by id, to read a few payloads out of many.

The index holds for each row its id, file, place in the file and the file's time
of change; it is dealt by ranges of the id and sorted, so the statistics of its
own files and row groups narrow a look-up. A look-up reads the index with the
bounds of the ids it wants, then only the files that hold them, with the same
bounds pushed to their row groups, and keeps the rows by their exact place. No
payload is read to find out where a payload lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources.shared import stored

#: Up to so many ids and files are named in the scan; more are narrowed by bounds and joined.
NAMED = 1000


def build_index(spark: SparkSession, data: str, index: str, key: str, source: tuple[str, str] | None = None) -> None:
    """Write the index of the Parquet files under data. source, (column, value), must hold in every row or the build raises."""
    rows = spark.read.parquet(data)
    where: Column = F.lit(True)
    if source:
        column, value = source
        wrong = F.raise_error(F.concat(F.lit(f"{column} is not {value}: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("boolean")
        where = F.when(F.col(column).eqNullSafe(F.lit(value)), True).otherwise(wrong)
    placed = rows.where(where).select(F.col(key).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("_metadata.file_modification_time").alias("changed"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed.where("id IS NOT NULL").repartitionByRange(parts, "id").sortWithinPartitions("id", "file", "row").write.mode("overwrite").parquet(index)


def find(spark: SparkSession, index: str, wanted: DataFrame, key: str) -> DataFrame:
    """id, file, row, changed: where each wanted id is first, by file and place."""
    ids = wanted.select(F.col(key).alias("id")).where("id IS NOT NULL").distinct()
    rows = spark.read.parquet(index).where(_narrowed(ids, "id"))
    return rows.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("file", "row", "changed")).alias("_at")).select("id", "_at.*")


def _narrowed(ids: DataFrame, column: str) -> Column:
    """A condition on column that a scan can push down: the ids by name if they are few, else their bounds."""
    some = [r[0] for r in ids.limit(NAMED + 1).collect()]
    if len(some) <= NAMED:
        return F.col(column).isin(some) if some else F.lit(False)
    lo, hi = ids.agg(F.min("id"), F.max("id")).first()
    return F.col(column).between(lo, hi)


def lookup(spark: SparkSession, data: str, index: str, wanted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and columns of the wanted rows that there are. A file that changed since the index was built raises."""
    at = stored(find(spark, index, wanted, key), "found-rows")
    files = [r[0] for r in at.select("file").distinct().limit(NAMED + 1).collect()]
    rows = spark.read.parquet(data)
    if len(files) <= NAMED:
        rows = rows.where(F.col("_metadata.file_path").isin(files) if files else F.lit(False))
    rows = rows.where(_narrowed(at.select("id"), key))
    rows = rows.select(key, *[c for c in columns if c != key], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), F.col("_metadata.file_modification_time").alias("_changed"))
    found = rows.join(at, (F.col("_file") == F.col("file")) & (F.col("_row") == F.col("row")))
    stale = F.raise_error(F.concat(F.lit("changed since the index was built: "), F.col("file"))).cast("boolean")
    return found.where(F.when(F.col("_changed") == F.col("changed"), True).otherwise(stale)).select(key, *[c for c in columns if c != key])


def files_read(rows: DataFrame) -> int:
    """How many data files the last scans of a plan list; the plan must have been run."""
    plan, total = rows._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numFiles"):
            total += metrics.apply("numFiles").value()
    return total
