"""Sinks: membership, labels, result documents, dataset export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.pairing import append_unique


def write_membership(frames: DataFrame, path: str) -> None:
    """Replace the written samples only."""
    frames.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample").parquet(path)


def write_labels(existing: DataFrame, new: DataFrame, path: str) -> None:
    """Append labels whose (frame_id, rater, pass) is new; a duplicate raises."""
    append_unique(existing, new, ["frame_id", "rater", "pass"]).write.mode("append").parquet(path)


def write_document(rows: DataFrame, path: str) -> None:
    """A few result rows as one JSON array in one file, in the order of their values; json_records reads it back."""
    rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns))))).coalesce(1).write.mode("overwrite").text(path)


def export_dataset(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines in its own folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def frame_index(frames: DataFrame) -> DataFrame:
    """One JSON document a frame, fields in a fixed order."""
    return frames.select("frame_id", F.to_json(F.struct(*sorted(frames.columns))).alias("document"))
