"""Reliability bins, calibration error, abstention thresholds and cascade evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import vocab
from assayer.functions.scalars import wilson_lower


def reliability_bins(rows: DataFrame, confidence: str, correct: str, *by: str, bins: int = vocab.BINS) -> DataFrame:
    """by, bin, lo, hi, n, mean_conf, accuracy for every bin, empty ones with nulls. The index truncates confidence / width."""
    index = F.least((F.col(confidence) / (1.0 / bins)).cast("int"), F.lit(bins - 1))
    found = rows.groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_conf"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        grid = rows.select(*by).distinct().crossJoin(F.broadcast(grid))
    return grid.join(found, [*by, "bin"], "left").select(*by, "bin", (F.col("bin") / float(bins)).alias("lo"), ((F.col("bin") + 1) / float(bins)).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"), "mean_conf", "accuracy")


def ece(bins: DataFrame, *by: str) -> DataFrame:
    """Expected calibration error: gaps weighted by the bins' shares; 0 without rows."""
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_conf")))
    return bins.groupBy(*by).agg(F.sum("n").alias("n"), F.when(F.sum("n") > 0, gap / F.sum("n")).otherwise(0.0).alias("ece"))


def report(rows: DataFrame, confidence: str, correct: str, *by: str) -> DataFrame:
    """by, n, ece and the bins as an array of structs; groups (judge, kind) are never pooled."""
    b = reliability_bins(rows, confidence, correct, *by)
    nested = b.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "n", "mean_conf", "accuracy"))).alias("bins"))
    return ece(b, *by).join(nested, list(by))


def threshold(rows: DataFrame, confidence: str, correct: str, key: str, floor: float = vocab.FLOOR, level: float = 0.95) -> DataFrame:
    """threshold, answered: the confidence of the last row, from the most confident down, up to which the bound on
    accuracy holds. Both are null where no row passes. Running sums use partitions by confidence band first, so no
    task sees all rows."""
    band = F.floor(F.col(confidence) * 1000)
    banded = rows.select(F.col(confidence).alias("_c"), F.col(correct).cast("long").alias("_y"), F.col(key).alias("_key"), band.alias("_band"))
    per = banded.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_band", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(above), F.lit(0)).alias("_s0"))
    w = Window.partitionBy("_band").orderBy(F.desc("_c"), "_key").rowsBetween(Window.unboundedPreceding, 0)
    run = banded.join(F.broadcast(before), "_band").select("_c", (F.count(F.lit(1)).over(w) + F.col("_n0")).alias("n"), (F.sum("_y").over(w) + F.col("_s0")).alias("k"))
    passing = run.where(wilson_lower(F.col("k"), F.col("n"), level) >= floor)
    return passing.agg(F.min("_c").alias("threshold"), F.max("n").alias("answered"))


def coverage_and_floor(rows: DataFrame, confidence: str, correct: str, limit: DataFrame) -> DataFrame:
    """Share answered at the threshold (ties answered) and accuracy among them, 0 where none."""
    answered = F.col(confidence) >= F.col("threshold")
    joined = rows.crossJoin(F.broadcast(limit.select("threshold")))
    return joined.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(answered, 1.0).otherwise(0.0)), F.lit(0.0)).alias("coverage"), F.coalesce(F.avg(F.when(answered, F.col(correct).cast("double"))), F.lit(0.0)).alias("accuracy")
    )


def required_threshold(rows: DataFrame, confidence: str, correct: str, key: str, floor: float = vocab.FLOOR, level: float = 0.95) -> DataFrame:
    """threshold(), raising when run if no confidence reaches the floor: a cascade must not run without one."""
    never = F.raise_error(F.lit(f"no threshold reaches the floor of {floor}")).cast("double")
    return threshold(rows, confidence, correct, key, floor, level).select(F.when(F.col("threshold").isNull(), never).otherwise(F.col("threshold")).alias("threshold"), "answered")
