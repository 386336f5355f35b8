"""The registered query of each operator, applied with its production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, collocations, media, near_dups, neighbours, packing, pitman_yor, quality, repeats, target_tries, top_k, toxicity, url_rules
from assayer.llm.tables import table

#: The vocabulary file of the registered queries; operators take any path.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Labels train the toxicity classifier only where crc32 of the id's digits mod 5 is not 0.
def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    clf = toxicity.train_classifier(docs, table(spark, sf_dir, "labels"), ~held_out("_id"))
    return toxicity.score_documents(docs, clf).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.RULES)


def op11_target_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_tries.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_repeats": op2_repeats,
    "op3_pitman_yor": op3_pitman_yor,
    "op4_media": op4_media,
    "op6_top_k": op6_top_k,
    "op7_quality": op7_quality,
    "op5_packing": op5_packing,
    "op8_near_dups": op8_near_dups,
    "op9_toxicity": op9_toxicity,
    "op10_url_filter": op10_url_filter,
    "op11_target_tries": op11_target_tries,
    "op12_collocations": op12_collocations,
    "op13_neighbours": op13_neighbours,
}

ORACLES: dict[str, str] = {"op10_url_filter": url_rules.ORACLE, "op12_collocations": collocations.ORACLE}
