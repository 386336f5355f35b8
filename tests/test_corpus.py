"""Tar corpora: what is written is what a tar reader sees, scans go on, bad shards are rows."""

import os
import tarfile

from pyspark.sql import functions as F

from assayer.sources import corpus

SCHEMA = "shard string, stem string, payload binary, sidecar string"


def rows(spark, names=("a", "b"), n=6):
    made = [(s, f"c{i:02}", bytes([65 + i]) * (i * 700), None if i == 2 else '{"duration_sec": %d, "codec": "h265", "width": 4}' % i) for s in names for i in range(n)]
    return spark.createDataFrame([*made, (None, "x", b"", None), ("a", None, b"", None)], SCHEMA)


def test_shards_are_tars_and_manifests_find_their_clips(spark, tmp_path):
    folder, path = str(tmp_path / "corpus"), str(tmp_path / "manifest")
    assert corpus.write_shards(rows(spark), folder, "shard", "stem", "payload", "sidecar") == ["a.tar", "b.tar"]
    assert sorted(os.listdir(folder)) == ["a.tar", "b.tar"] and os.path.getsize(f"{folder}/a.tar") % 512 == 0
    with tarfile.open(f"{folder}/a.tar") as t:
        assert [m.name for m in t][:5] == ["c00.mp4", "c00.json", "c01.mp4", "c01.json", "c02.mp4"]
        places = {m.name: (m.offset_data, m.size) for m in t}
    assert corpus.extend_manifest(spark, folder, path, limit=1) == {"known": 0, "scanned": 1, "failed": 0}
    assert corpus.extend_manifest(spark, folder, path) == {"known": 1, "scanned": 1, "failed": 0}
    assert corpus.extend_manifest(spark, folder, path) == {"known": 2, "scanned": 0, "failed": 0}
    got = corpus.known_manifest(spark, path).collect()
    assert len(got) == 10 and "c02" not in {r.clip_id for r in got}
    for r in got:
        i = int(r.clip_id[1:])
        assert (r.duration_sec, r.codec, r.width, r.fps) == (float(i), "h265", 4, None)
        with open(f"{folder}/{r.shard}", "rb") as f:
            f.seek(r.mp4_offset)
            assert f.read(r.mp4_size) == bytes([65 + i]) * (i * 700)
        assert r.shard != "a.tar" or places[f"{r.clip_id}.mp4"] == (r.mp4_offset, r.mp4_size)


def test_a_bad_shard_is_a_row(spark, tmp_path):
    folder, path = str(tmp_path / "corpus"), str(tmp_path / "manifest")
    corpus.write_shards(rows(spark), folder, "shard", "stem", "payload", "sidecar")
    whole = open(f"{folder}/b.tar", "rb").read()
    with tarfile.open(f"{folder}/b.tar") as t:
        cut = t.getmember("c05.json").offset_data + 3
    with open(f"{folder}/b.tar", "wb") as f:
        f.write(whole[:cut])
    os.mkdir(f"{folder}/sub")
    open(f"{folder}/note.txt", "w").close()
    assert corpus.list_shards(spark, folder).count() == 2
    assert corpus.extend_manifest(spark, folder, path) == {"known": 0, "scanned": 1, "failed": 1}
    bad = corpus.scan(corpus.list_shards(spark, folder)).where(F.col("error").isNotNull()).collect()
    assert [(r.shard, r.error) for r in bad] == [("b.tar", "ValueError: c05.json is cut off")]
    with open(f"{folder}/b.tar", "wb") as f:
        f.write(whole)
    assert corpus.extend_manifest(spark, folder, path) == {"known": 1, "scanned": 1, "failed": 0}


def test_windows_save_reads():
    import io

    ranges = corpus.Ranges(io.BytesIO(bytes(range(256)) * 100))
    assert ranges.read(10, 5) == bytes(range(10, 15)) and ranges.read(600, 4) == bytes(range(88, 92)) and ranges.reads == 1
    assert ranges.read(20_000, 3) == bytes((20_000 + i) % 256 for i in range(3)) and ranges.reads == 2 and ranges.read(25_598, 10) == bytes([254, 255])
