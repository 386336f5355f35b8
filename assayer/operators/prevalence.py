"""Prediction-powered prevalence from moments: one aggregate a side, no second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalars import Z95


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def moments(gold: DataFrame, unlabelled: DataFrame, truth: str, answer: str, *by: str) -> DataFrame:
    """by, n, N and the means, variances and covariance that the estimates need (0 where a variance has one row)."""
    y, f = F.col(truth).cast("double"), F.col(answer).cast("double")
    g = gold.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("y_mean"), F.avg(f).alias("f_mean"), _zero(F.var_samp(y)).alias("y_var"), _zero(F.var_samp(f)).alias("f_var"), _zero(F.covar_samp(f, y)).alias("cov"))
    u = unlabelled.groupBy(*by).agg(F.count(F.lit(1)).alias("n_unlabelled"), F.avg(f).alias("u_mean"), _zero(F.var_samp(f)).alias("u_var"))
    return g.join(u, list(by)) if by else g.crossJoin(u)


def moments_by_presence(answers: DataFrame, truth: str, answer: str, there: str, *by: str) -> DataFrame:
    """moments() of answers beside their truth, in one pass: there tells the rows that have a truth from the unlabelled ones.
    Groups that lack either part have no row."""
    y, f = F.col(truth).cast("double"), F.col(answer).cast("double")
    own, rest = (lambda c: F.when(F.col(there), c)), (lambda c: F.when(~F.col(there), c))
    m = answers.groupBy(*by).agg(
        F.count_if(F.col(there)).alias("n"), F.avg(own(y)).alias("y_mean"), F.avg(own(f)).alias("f_mean"), _zero(F.var_samp(own(y))).alias("y_var"), _zero(F.var_samp(own(f))).alias("f_var"),
        _zero(F.covar_samp(own(f), own(y))).alias("cov"), F.count_if(~F.col(there)).alias("n_unlabelled"), F.avg(rest(f)).alias("u_mean"), _zero(F.var_samp(rest(f))).alias("u_var"),
    )
    return m.where("n > 0 and n_unlabelled > 0") if by else m


def ppi(m: DataFrame, tuned: bool = True) -> DataFrame:
    """Adds lam, rectifier, value, var_gold, var_unlabelled, se, lo, hi (not clipped) to moments."""
    lam = F.when(F.col("f_var") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cov") / F.col("f_var")))).otherwise(0.0) if tuned else F.lit(1.0)
    m = m.withColumn("lam", lam)
    m = m.withColumn("rectifier", F.col("y_mean") - F.col("lam") * F.col("f_mean"))
    m = m.withColumn("value", F.col("lam") * F.col("u_mean") + F.col("rectifier"))
    m = m.withColumn("var_gold", F.greatest(F.col("y_var") - 2 * F.col("lam") * F.col("cov") + F.col("lam") * F.col("lam") * F.col("f_var"), F.lit(0.0)))
    m = m.withColumn("var_unlabelled", F.col("lam") * F.col("lam") * F.col("u_var") / F.col("n_unlabelled"))
    m = m.withColumn("se", F.sqrt(F.col("var_gold") / F.col("n") + F.col("var_unlabelled")))
    return m.withColumn("lo", F.col("value") - Z95 * F.col("se")).withColumn("hi", F.col("value") + Z95 * F.col("se"))


def naive(responses: DataFrame, answer: str, *by: str) -> DataFrame:
    """Mean over all ok answers, gold frames included."""
    return responses.where("status = 'ok'").groupBy(*by).agg(F.avg(F.col(answer).cast("double")).alias("naive"), F.count(F.lit(1)).alias("n_naive"))


def margins(estimates: DataFrame, arms: DataFrame, arm: str) -> DataFrame:
    """For each (left, right, published) of arms: the difference of two arms' values with its interval, whether the
    published difference lies inside, and whether its sign is flipped."""
    side = lambda s: estimates.select(F.col(arm).alias(s), F.col("value").alias(f"{s}_value"), F.col("se").alias(f"{s}_se"))
    both = arms.join(side("left"), "left").join(side("right"), "right")
    delta, se = F.col("left_value") - F.col("right_value"), F.sqrt(F.pow("left_se", F.lit(2)) + F.pow("right_se", F.lit(2)))
    out = both.select("left", "right", "published", delta.alias("delta"), se.alias("se"), (delta - Z95 * se).alias("lo"), (delta + Z95 * se).alias("hi"))
    return out.withColumns({"inside": F.col("published").between(F.col("lo"), F.col("hi")), "flipped": F.signum("published") * F.signum("delta") < 0})


def gold_needed(var_left: Column, var_right: Column, floor: Column, target_se: Column) -> Column:
    """Gold rows an arm needs for a target standard error; null where the unlabelled part alone exceeds it."""
    return F.when(target_se > floor, F.ceil((var_left + var_right) / (target_se * target_se - floor * floor)))
