"""Pairing labels with responses: duplicate policies, joins, exclusions by reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The first arrival of each key: how a response log is read."""
    return _one_per_key(df, keys, [F.asc(arrival)])


def last_wins(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The last arrival of each key: how responses are paired."""
    return _one_per_key(df, keys, [F.desc(arrival)])


def pair(labels: DataFrame, responses: DataFrame, on: str = "frame_id") -> DataFrame:
    """Inner join of labels and responses, whatever the response's status; both sides unique by `on`."""
    return labels.join(responses, on)


def comparable(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("status") == "ok")


def exclusions(pairs: DataFrame, *by: str) -> DataFrame:
    """How many pairs each other status keeps out."""
    return pairs.where(F.col("status") != "ok").groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def exclusion_map(pairs: DataFrame, *by: str) -> DataFrame:
    """by, n_excluded, excluded_why (map from status to count)."""
    counts = exclusions(pairs, *by)
    return counts.groupBy(*by).agg(F.sum("n").alias("n_excluded"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("excluded_why"))


def gold_and_unlabelled(gold: DataFrame, responses: DataFrame, on: str = "frame_id") -> tuple[DataFrame, DataFrame]:
    """Gold joined to its ok response (a gold row without one raises when run), and the ok responses of other frames."""
    ok = comparable(responses)
    joined = gold.join(ok.withColumn("_there", F.lit(True)), on, "left")
    checked = joined.where(F.assert_true(F.col("_there").isNotNull(), "a gold row has no ok response").isNull()).drop("_there")
    return checked, ok.join(gold.select(on), on, "left_anti")


def complete_panel(responses: DataFrame, member: str, on: str = "frame_id", *by: str) -> DataFrame:
    """Responses of the frames that every member (judge, variant) answered ok."""
    ok = comparable(responses)
    members = responses.groupBy(*by).agg(F.count_distinct(member).alias("_all")) if by else responses.agg(F.count_distinct(member).alias("_all"))
    full = ok.groupBy(*by, on).agg(F.count_distinct(member).alias("_n"))
    full = (full.join(members, list(by)) if by else full.crossJoin(F.broadcast(members))).where("_n = _all").select(*by, on)
    return ok.join(full, [*by, on], "left_semi")


def timed_retest(primary: DataFrame, retest: DataFrame, on: str = "frame_id", at: str = "labelled_at") -> DataFrame:
    """Primary and retest of a frame, where the retest is not earlier; columns of the retest are prefixed re_."""
    again = retest.select(F.col(on), *[F.col(c).alias(f"re_{c}") for c in retest.columns if c != on])
    return primary.join(again, on).where(F.col(f"re_{at}") >= F.col(at))


def pending(pool: DataFrame, done: DataFrame, on: str = "frame_id") -> DataFrame:
    return pool.join(done.select(on), on, "left_anti")


def append_unique(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, after a check that none of their keys exists (raises when run)."""
    marked = new.join(existing.select(*keys).distinct().withColumn("_dup", F.lit(True)), keys, "left")
    return marked.where(F.assert_true(F.col("_dup").isNull(), "a label with this key exists").isNull()).select(*new.columns)
