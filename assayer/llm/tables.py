"""Reading inputs and cutting lineage on storage that every executor shares."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where each table that written() made lies, as long as the DataFrame is held.
_folders: dict[int, tuple] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a temporary one on this machine, which only local mode
    shares with its executors; any other master raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="assayer-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffle files behind df go as soon as the table is there
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[id(out)] = (path, weakref.finalize(out, _folders.pop, id(out), None))
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() once no later step reads them."""
    for df in tables:
        path = _folders.pop(id(df), (None, None))[0]
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def refuse_clashes(keep: tuple[str, ...], *own: str) -> None:
    """Columns to pass by must not have the name of a column that the operator makes; case does not tell names apart."""
    clash = {c.lower() for c in keep} & {c.lower() for c in own}
    if clash:
        raise ValueError(f"keep names columns of the result: {', '.join(sorted(clash))}")


def volume(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, bytes of text) of a table; two numbers are all that reaches the driver."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return int(row["n"] or 0), int(row["b"] or 0)


def pieces(total_bytes: int, each: int) -> int:
    """How many pieces of about `each` bytes the text makes, at least one."""
    return max(1, -(-total_bytes // each))


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def int64s(column: pa.ChunkedArray | pa.Array):
    return column.to_numpy(zero_copy_only=False).astype("int64", copy=False)
