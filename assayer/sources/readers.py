"""Readers of evaluation tables, membership, labels and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.functions import schemas
from assayer.functions.scalars import content_id, vendor_yes_no


def json_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; blank lines are skipped and a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.MANIFEST)


def responses(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.RESPONSE)


def _places(table: DataFrame) -> DataFrame:
    """The table with frame_index, the row's place from 0 when its files are read in the order of their names."""
    file = F.col("_metadata.file_name")
    sizes = table.groupBy(file.alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    starts = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = table.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.join(F.broadcast(starts), "_file").withColumn("frame_index", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def evaluation_frames(spark: SparkSession, path: str, id_prefix: str | None = None, through: bool = False) -> DataFrame:
    """frame_id, frame_index (the row's place in its file, or, if through, in all files of the folder in the order of their
    names) of frames with image bytes; without an id column the id is the image's digest behind id_prefix. Only the columns
    asked for are scanned."""
    table = spark.read.parquet(path)
    raw = _places(table) if through else table.select("*", F.col("_metadata.row_index").alias("frame_index"))
    ident = F.col("frame_id") if id_prefix is None else content_id(id_prefix, F.col("image.bytes"))
    return raw.where(F.length("image.bytes") > 0).select(ident.alias("frame_id"), "frame_index")


def published_labels(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """frame_id, hand_count, active_labor (boolean) of all or the wanted frames."""
    rows = spark.read.parquet(path).select("frame_id", "hand_count", vendor_yes_no(F.col("active_labor")).alias("active_labor"))
    return rows if wanted is None else rows.join(wanted.select("frame_id"), "frame_id", "left_semi")


def one_source_only(rows: DataFrame, expected: str) -> DataFrame:
    """The rows, after a check (when run) that each comes from the expected dataset."""
    return rows.where(F.assert_true(F.col("source_dataset") == expected, "unexpected source_dataset").isNull())


def lookup_bytes(roots: list[DataFrame], wanted: DataFrame) -> DataFrame:
    """frame_id, bytes of wanted frames over several arms, the first arm that has one winning."""
    from assayer.operators.pairing import first_wins

    out = None
    for i, r in enumerate(roots):
        rows = r.select("frame_id", F.col("image.bytes").alias("bytes"), F.lit(i).alias("_arm")).join(wanted.select("frame_id"), "frame_id", "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return first_wins(out, ["frame_id"], "_arm").drop("_arm")


def unpinned_revisions(frames: DataFrame, pins: DataFrame) -> DataFrame:
    """Distinct (corpus, corpus_rev) that the pin table does not hold; must be empty."""
    return frames.select("corpus", "corpus_rev").distinct().join(pins, ["corpus", "corpus_rev"], "left_anti")


def markdown_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of the tables in a Markdown file that have the wanted number of cells, header and rule left out."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = spark.read.text(path).where(F.trim("value").startswith("|")).select(cells.alias("c")).where((F.size("c") == len(columns)) & ~F.col("c")[0].rlike(r"^:?-+:?$"))
    return rows.select(*[F.col("c")[i].alias(n) for i, n in enumerate(columns)]).where(F.col(columns[0]) != columns[0])
