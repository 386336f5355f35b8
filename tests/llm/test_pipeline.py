"""run() against its stages one by one, each checked on its own input."""

import zlib

import pytest
from brute import components, hostile, repeats
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import quality, toxicity
from assayer.llm import repeats as repeats_
from assayer.llm.tables import table, written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], DATA), "test-stage"))
    assert [s.columns for s in seen[:-1]] == [docs.columns] * 5
    kept = seen[1].join(labels, "doc_id")
    assert kept.where("quality = 0").count() <= 3 and seen[1].count() <= docs.count()
    before = {r.doc_id: r.text for r in seen[2].collect()}
    want, _ = components(list(before.items()))
    assert {r.doc_id for r in seen[3].collect()} == {i for i, c in want.items() if i == c}
    rows = [(r.doc_id, r.text) for r in seen[3].collect()]
    left = dict(zip((i for i, _ in rows), repeats(rows)))
    for r in seen[4].collect():
        n, gone, _, _ = left[r.doc_id]
        assert abs(len(r.text.encode()) - (n - gone)) <= 4 * left[r.doc_id][2] and r.n_chars == len(r.text)
    assert {r.doc_id for r in seen[5].select("doc_id").collect()} == {r.doc_id for r in seen[4].collect()}
    once = corpus_pipeline.run(spark, DATA)
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(tuple, once.select(key).collect())) == sorted(map(tuple, seen[5].select(key).collect()))
    assert once.agg(F.sum("length")).first()[0] == sum(r.n for r in seen[5].groupBy("doc_id").agg(F.max("doc_tokens").alias("n")).collect())
    assert zlib.crc32(b"") == 0


def test_toxicity_stage(spark):
    """On the next larger tables: the smallest have too few toxic rows to learn from."""
    d = DATA.replace("0.001", "0.01")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    left = corpus_pipeline.drop_toxic(spark, docs, d).select("doc_id").withColumn("left", F.lit(1))
    rows = docs.join(labels, "doc_id").join(left, "doc_id", "left").groupBy("toxic").agg(F.count("left").alias("left"), F.count(F.lit(1)).alias("n")).collect()
    share = {r.toxic: r.left / r.n for r in rows}
    assert share[1] < 0.4 and share[0] > 0.99


CLASHES = ("kept", "predicted", "score", "log_weight", "sample_key", "n_bytes", "_text", "_chunk", "n_chars", "KEPT_TEXT", "component_id", "a.b")


def test_columns_with_the_names_of_results_come_back(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text", *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in CLASHES if c != "n_chars"], F.col("n_chars"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, DATA), "test-clash")
        assert now.columns == docs.columns
    rows = now.collect()
    assert len(rows) > 50 and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASHES if c != "n_chars")
    for f in (quality.importance_sample, toxicity.score_documents):
        with pytest.raises(ValueError, match="keep names columns of the result"):
            f(docs, table(spark, DATA, "labels"), keep=("score", "kept"))
    with pytest.raises(ValueError, match="_chunk"):
        repeats_.remove_repeats(docs, keep=("_chunk",))


@pytest.mark.parametrize("kind", ["hostile", "empty", "null"])
def test_hostile_documents(spark, kind, tmp_path):
    docs = hostile(spark).drop("_text", "score")
    docs = docs.where("false") if kind == "empty" else docs.withColumn("text", F.lit(None).cast("string")) if kind == "null" else docs
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (8, 0, 1), (9, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, written(stage(spark, now, str(tmp_path)), "test-hostile")
        assert now.columns == docs.columns and now.count() <= before.count()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
    if kind == "empty":
        assert packed.count() == 0
