"""A Spark data source of tar member headers: name, data offset, size of regular files, payloads skipped."""

from __future__ import annotations

import io
import os
import tarfile
from collections.abc import Callable, Iterator

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from assayer.sources.shared import shared_folder

BLOCK = 512


def members(read: Callable[[int, int], bytes]) -> Iterator[tuple[str, int, int]]:
    """Walk the 512-byte headers; read(offset, size) gives bytes of the archive."""
    at = 0
    while len(head := read(at, BLOCK)) == BLOCK and head.strip(b"\0"):
        name = head[:100].split(b"\0", 1)[0].decode("utf-8", "replace")
        prefix = head[345:500].split(b"\0", 1)[0].decode("utf-8", "replace") if head[257:262] == b"ustar" else ""
        field = head[124:136].strip(b" \0") or b"0"
        if field.strip(b"01234567"):  # not a header any more: the walk ends here
            return
        size = int(field, 8)
        if head[156:157] in (b"0", b"\0"):
            yield (f"{prefix}/{name}" if prefix else name), at + BLOCK, size
        at += BLOCK + -(-size // BLOCK) * BLOCK


class _Shard(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_Shard(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, path = FileSystem.from_uri(partition.path)
        with fs.open_input_file(path) as f:

            def at(offset: int, size: int) -> bytes:
                f.seek(offset)
                return f.read(size)

            for name, offset, size in members(at):
                yield os.path.basename(partition.path), name, offset, size


class TarMembers(DataSource):
    """format("tar_members").option("paths", "a.tar,b.tar"): one partition a shard, paths or URIs that every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "shard string, name string, data_offset long, size long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options["paths"].split(",") if p])


def clips(found: DataFrame) -> DataFrame:
    """Pairs of <stem>.mp4 and <stem>.json; unpaired members drop out."""
    parts = found.select("shard", F.regexp_extract("name", r"^(.*)\.([^.]+)$", 1).alias("stem"), F.lower(F.regexp_extract("name", r"^(.*)\.([^.]+)$", 2)).alias("ext"), "data_offset", "size")
    return parts.where("ext in ('mp4', 'json')").groupBy("shard", "stem").agg(
        F.max(F.when(F.col("ext") == "mp4", F.col("data_offset"))).alias("mp4_offset"), F.max(F.when(F.col("ext") == "mp4", F.col("size"))).alias("mp4_size"), F.max(F.when(F.col("ext") == "json", F.col("data_offset"))).alias("json_offset")
    ).where("mp4_offset is not null and json_offset is not null")


def extension_histogram(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by, F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def demo_shards(spark: SparkSession) -> DataFrame:
    """Clips of two small shards written to the shared folder for the purpose: the registered example."""
    folder, paths = shared_folder(spark, "tar"), []
    for s in range(2):
        whole = io.BytesIO()
        with tarfile.open(fileobj=whole, mode="w", format=tarfile.USTAR_FORMAT) as t:
            for i in range(3):
                for ext, body in (("mp4", b"x" * (700 * (i + 1))), ("json", b"{}")):
                    if (s, i, ext) != (1, 2, "json"):
                        info = tarfile.TarInfo(f"clip{s}{i}.{ext}")
                        info.size = len(body)
                        t.addfile(info, io.BytesIO(body))
        paths.append(f"{folder}/shard{s}.tar")
        fs, path = FileSystem.from_uri(paths[-1])
        fs.create_dir(os.path.dirname(path))
        with fs.open_output_stream(path) as f:
            f.write(whole.getvalue())
    spark.dataSource.register(TarMembers)
    return clips(spark.read.format("tar_members").option("paths", ",".join(paths)).load())
