"""A training corpus in five stages: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; all but the last return the columns of docs. run() writes each stage's
rows as Parquet and reads them again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import near_dups, packing, quality, repeats, toxicity
from assayer.llm.queries import held_out, vocabulary_path
from assayer.llm.tables import table, written


def _set_aside(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], dict[str, str]]:
    """docs with the columns that no stage reads under names that no stage uses, those names, and what each was."""
    names = {c: f"passed_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return plain, tuple(names.values()), names


def _back(kept: DataFrame, docs: DataFrame, names: dict[str, str], **made: Column) -> DataFrame:
    """The columns of docs again, those in made computed anew."""
    return kept.select(*[(made[c] if c in made else F.col(names.get(c, c))).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good rows keeps."""
    plain, aside, names = _set_aside(docs)
    rated = quality.importance_sample(plain, table(spark, sf_dir, "labels"), keep=("text", *aside))
    return _back(rated.where("kept"), docs, names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not predict toxic."""
    plain, aside, names = _set_aside(docs)
    clf = toxicity.train_classifier(plain, table(spark, sf_dir, "labels"), ~held_out("_id"))
    return _back(toxicity.score_documents(plain, clf, keep=("text", *aside)).where("predicted = 0"), docs, names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    rejected = near_dups.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id")
    return docs.join(rejected, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes or more that a document with a smaller id has."""
    plain, aside, names = _set_aside(docs)
    left = repeats.remove_repeats(plain, keep=aside, kept_text=True)
    return _back(left, docs, names, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 4096 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), vocabulary_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeats),
    ("packing", pack),
]

#: Sketches, samplers and the tokenizer have no form in SQL; the tests hold run() against its stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
