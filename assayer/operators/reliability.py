"""Agreement of a rater with an earlier self, assembled results, per-task outcomes, and judge quality across corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalars import Z95
from assayer.operators.agreement import agreement
from assayer.operators.pairing import comparable, exclusion_map, last_wins
from assayer.operators.prevalence import moments, ppi
from assayer.operators.resample import cluster_interval


def retest_pairs(primary: DataFrame, retest: DataFrame, arrival: str, on: str = "frame_id") -> DataFrame:
    """Primary labels with the last retest of their frame, whenever it was; the retest's columns are prefixed re_."""
    again = last_wins(retest, [on], arrival)
    return last_wins(primary, [on], arrival).join(again.select(on, *[F.col(c).alias(f"re_{c}") for c in again.columns if c != on]), on)


def task_outcomes(responses: DataFrame, *keep: str) -> DataFrame:
    """keep, task, value: each ok answer as 0 or 1 for every task that it answers (hands >= 1, hands = 2, manipulation)."""
    tasks = {"hands_ge_1": F.col("hands") >= 1, "hands_eq_2": F.col("hands") == 2, "manipulation": F.col("manip")}
    rows = F.array(*[F.struct(F.lit(t).alias("task"), c.cast("double").alias("value")) for t, c in tasks.items()])
    return comparable(responses).select(*keep, F.explode(rows).alias("_t")).select(*keep, "_t.*").where(F.col("value").isNotNull())


def assembled(pairs: DataFrame, a: str, b: str, space: tuple, *by: str) -> DataFrame:
    """by, n, n_excluded, excluded_why, raw, ac1, kappa: agreement over the comparable pairs beside what was left out and why."""
    out = agreement(comparable(pairs), a, b, space, *by).join(exclusion_map(pairs, *by), list(by), "left")
    return out.withColumns({"n_excluded": F.coalesce("n_excluded", F.lit(0).cast("long")), "excluded_why": F.coalesce("excluded_why", F.create_map().cast("map<string,bigint>"))})


def direction_holds(hands: DataFrame, manip: DataFrame, *by: str) -> DataFrame:
    """by, the AC1 of both tasks, and whether that of hands is greater."""
    side = lambda df, name: df.select(*by, F.col("ac1").alias(name))
    both = side(hands, "hands_ac1").join(side(manip, "manip_ac1"), list(by))
    return both.withColumn("holds", F.col("hands_ac1") > F.col("manip_ac1"))


def judge_quality(graded: DataFrame, correct: str, *by: str) -> DataFrame:
    """by, j: the share of answers that agree with gold."""
    return graded.groupBy(*by).agg(F.avg(F.col(correct).cast("double")).alias("j"))


def quality_gap(quality: DataFrame, *by: str) -> DataFrame:
    """by, delta_j: the range of j over the other groups."""
    return quality.groupBy(*by).agg((F.max("j") - F.min("j")).alias("delta_j"))


def disparity(counts: DataFrame, count: str) -> DataFrame:
    """n_groups, ratio of the largest to the smallest count; no groups, or a count that is not positive, raises when run."""
    out = counts.agg(F.count(F.lit(1)).alias("n_groups"), F.max(count).alias("_hi"), F.min(count).alias("_lo"))
    sound: Column = (F.col("n_groups") > 0) & (F.col("_lo") > 0)
    return out.where(F.assert_true(sound, "counts must be there and positive").isNull()).select("n_groups", (F.col("_hi") / F.col("_lo")).alias("ratio"))


def clustered_ppi(gold: DataFrame, unlabelled: DataFrame, truth: str, answer: str, cluster: str, name: str, resamples: int, tuned: bool = True) -> DataFrame:
    """Prediction-powered prevalence of one arm whose gold part's error comes from a bootstrap of whole clusters of residuals.

    lam, rectifier and value are those of ppi(); se is the root of the squared half width of the residuals' interval over z and
    the unlabelled part's variance."""
    point = ppi(moments(gold, unlabelled, truth, answer), tuned).select("n", "n_unlabelled", "lam", "rectifier", "value", "var_unlabelled")
    y, f = F.col(truth).cast("double"), F.col(answer).cast("double")
    residuals = gold.crossJoin(F.broadcast(point.select("lam"))).select(cluster, (y - F.col("lam") * f).alias("residual"))
    half = cluster_interval(residuals, "residual", cluster, name, resamples).select(((F.col("hi") - F.col("lo")) / (2 * Z95)).alias("se_gold"))
    out = point.crossJoin(F.broadcast(half)).withColumn("se", F.sqrt(F.col("se_gold") * F.col("se_gold") + F.col("var_unlabelled")))
    return out.withColumn("lo", F.col("value") - Z95 * F.col("se")).withColumn("hi", F.col("value") + Z95 * F.col("se"))


def assembled_in_full(pairs: DataFrame, a: str, b: str, space: tuple, cluster: str, by: str, resamples: int) -> DataFrame:
    """assembled() with ac1_lo, ac1_hi (rows resampled), and the design effect of the raw agreement over clusters beside its two intervals."""
    from assayer.operators.multinomial import ac1_intervals, design_effects

    ok = comparable(pairs)
    ci = ac1_intervals(ok, a, b, space, [by], resamples).select(by, F.col("lo").alias("ac1_lo"), F.col("hi").alias("ac1_hi"))
    same = ok.select(by, cluster, (F.col(a) == F.col(b)).cast("double").alias("_same"))
    effects = design_effects(same, pairs.select(by).distinct(), "_same", cluster, by, resamples).select(by, "clusters", "iid_lo", "iid_hi", "cluster_lo", "cluster_hi", "design_effect")
    return assembled(pairs, a, b, space, by).join(ci, by, "left").join(effects, by, "left")
