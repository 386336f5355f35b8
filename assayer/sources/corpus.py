"""Corpora of tar shards: written from rows, indexed by their headers alone, and kept as a manifest of clips.

A shard is walked by range reads of its headers; of the members only the sidecars
are read, never a clip. Shards that the manifest holds are skipped, so a scan
that stopped goes on where it was, and a shard that cannot be read becomes a
failure row instead of the end of the run.
"""

from __future__ import annotations

import io
import os
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import schemas
from assayer.sources.shared import stored
from assayer.sources.tar import members

WINDOW = 8192
SCANNED = "shard string, stem string, mp4_offset long, mp4_size long, sidecar string, error string"


class Ranges:
    """read(offset, size) of an open file through a window, so that neighbouring headers and sidecars are one read."""

    def __init__(self, file):
        self.file, self.start, self.held, self.reads = file, 0, b"", 0

    def read(self, offset: int, size: int) -> bytes:
        if not self.start <= offset <= offset + size <= self.start + len(self.held):
            self.file.seek(offset)
            self.start, self.held, self.reads = offset, self.file.read(max(size, WINDOW)), self.reads + 1
        return self.held[offset - self.start : offset - self.start + size]


def write_shards(rows: DataFrame, folder: str, shard: str, stem: str, payload: str, sidecar: str) -> list[str]:
    """A tar a shard in folder, members <stem>.mp4 and, where there is a sidecar, <stem>.json, in the order of stems.
    A shard is streamed out as its rows come and takes its name when it is whole. Returns the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else FileSystem.from_uri(f"file://{folder}")
        fs.create_dir(base, recursive=True)
        name = part = sink = archive = None

        def close() -> str:
            archive.close()
            sink.close()
            fs.move(part, f"{base}/{name}.tar")
            return f"{name}.tar"

        def add(member: str, body: bytes) -> None:
            info = tarfile.TarInfo(member)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))

        for batch in batches:
            done = []
            for s, t, body, side in zip(batch["_shard"], batch["_stem"], batch["_payload"], batch["_sidecar"], strict=True):
                if s != name:
                    done += [close()] if name is not None else []
                    name, part = s, f"{base}/.{s}.{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(part)
                    archive = tarfile.open(fileobj=sink, mode="w|", format=tarfile.USTAR_FORMAT)
                add(f"{t}.mp4", bytes(body or b""))
                if side is not None:
                    add(f"{t}.json", side.encode())
            yield pd.DataFrame({"file": done}, dtype=object)
        if name is not None:
            yield pd.DataFrame({"file": [close()]})

    named = rows.select(F.col(shard).cast("string").alias("_shard"), F.col(stem).cast("string").alias("_stem"), F.col(payload).cast("binary").alias("_payload"), F.col(sidecar).alias("_sidecar")).where("_shard IS NOT NULL AND _stem IS NOT NULL")
    written = named.repartition("_shard").sortWithinPartitions("_shard", "_stem").mapInPandas(run, "file string")
    return sorted(r["file"] for r in written.collect())  # a name a shard


def list_shards(spark: SparkSession, folder: str) -> DataFrame:
    """path, shard, bytes of the tar files in folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("shard"), F.col("length").alias("bytes"))


def scan(shards: DataFrame) -> DataFrame:
    """A row for each clip of the shards (path, shard) with its sidecar's text, and for a shard that cannot be read one with the error."""

    def one(path: str, shard: str) -> Iterator[tuple]:
        try:
            fs, file = FileSystem.from_uri(path)
            with fs.open_input_file(file) as f:
                ranges, clips, sides = Ranges(f), {}, {}
                for name, offset, size in members(ranges.read):
                    stem, _, ext = os.path.basename(name).rpartition(".")
                    if ext.lower() == "mp4":
                        clips[stem] = (offset, size)
                    elif ext.lower() == "json":
                        body = ranges.read(offset, size)
                        if len(body) < size:
                            raise ValueError(f"{name} is cut off")
                        sides[stem] = body.decode("utf-8", "replace")
            found = [(shard, stem, *clips[stem], sides[stem], None) for stem in clips if stem in sides]
        except Exception as e:  # noqa: BLE001  one bad shard must not end a run over a corpus
            found = [(shard, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
        yield from found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, s in zip(batch["path"], batch["shard"], strict=True) for r in one(p, s)]
            yield pd.DataFrame(rows, columns=["shard", "stem", "mp4_offset", "mp4_size", "sidecar", "error"]).astype({"mp4_offset": "Int64", "mp4_size": "Int64"})

    parts = max(1, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shards.select("path", "shard").repartition(parts, "path").mapInPandas(run, SCANNED)


def manifest_rows(scanned: DataFrame) -> DataFrame:
    """The scanned clips as manifest records: what the sidecar says and where the clip lies."""
    fields = [f for f in schemas.MANIFEST.fields if f.name not in ("shard", "clip_id", "mp4_offset", "mp4_size")]
    side = F.from_json("sidecar", type(schemas.MANIFEST)(fields))
    rows = scanned.where(F.col("error").isNull()).withColumn("_s", side)
    found = {f.name: F.col(f"_s.{f.name}") for f in fields} | {"clip_id": F.col("stem")}
    return rows.select(*[found.get(n, F.col(n)).alias(n) for n in schemas.MANIFEST.names])


def known_manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(schemas.MANIFEST).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.MANIFEST)


def extend_manifest(spark: SparkSession, folder: str, manifest: str, limit: int | None = None) -> dict[str, int]:
    """Scan the shards of folder that the manifest lacks (at most limit, by name) and append their clips; how many shards were
    known, scanned and failed. A failed or empty shard is scanned again next time."""
    shards = list_shards(spark, folder)
    known = known_manifest(spark, manifest).select("shard").distinct()
    pending = shards.join(known, "shard", "left_anti")
    pending = pending.orderBy("shard").limit(limit) if limit else pending
    before, pending = known.count(), stored(pending, "shards")
    scanned = stored(scan(pending), "scanned")
    manifest_rows(scanned).write.mode("append").json(manifest)
    failed = scanned.where(F.col("error").isNotNull()).count()
    return {"known": before, "scanned": pending.count() - failed, "failed": failed}
