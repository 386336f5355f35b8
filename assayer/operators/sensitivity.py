"""Rates by prompt variant, spreads, unanimity and pair agreement, replication verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import vocab


def headline_rates(responses: DataFrame, *by: str) -> DataFrame:
    """by, n_ok, at_least_one, two_hands, manipulation (0.0 where nothing is ok) and status counts."""
    ok = F.col("status") == "ok"
    rate = lambda c: F.coalesce(F.avg(F.when(ok, F.when(c, 1.0).otherwise(0.0))), F.lit(0.0))
    return responses.groupBy(*by).agg(
        F.count_if(ok).alias("n_ok"), rate(F.col("hands_visible") >= 1).alias("at_least_one"), rate(F.col("hands_visible") == 2).alias("two_hands"), rate(F.col("manipulation")).alias("manipulation"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in vocab.STATUSES[1:]],
    )


def within_tolerance(observed: str, published: str) -> tuple:
    gap = F.abs(F.col(observed) - F.col(published)) * 100
    return gap.alias("gap_pp"), (gap <= vocab.REPLICATION_PP).alias("within")


def spread(rates: DataFrame, value: str, variant: str, base: str, other: str) -> DataFrame:
    """Largest less smallest rate over variants in points, and the shift of one variant against the base."""
    r = rates.agg(((F.max(value) - F.min(value)) * 100).alias("spread_pp"), ((F.max(F.when(F.col(variant) == other, F.col(value))) - F.max(F.when(F.col(variant) == base, F.col(value)))) * 100).alias("shift_pp"))
    return r.select("spread_pp", (F.col("spread_pp") >= vocab.SPREAD_PP).alias("sensitive"), "shift_pp", (F.abs("shift_pp") >= vocab.SHIFT_PP).alias("shifted"))


def unanimity(complete: DataFrame, value: str, on: str = "frame_id") -> DataFrame:
    """n, ipr (share of frames with one answer), par (mean share of agreeing variant pairs), both null without frames.
    Pairs come from the counts of each answer, so no pair is built; one variant alone has no pairs and gives a null par."""
    counts = complete.groupBy(on, value).agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy(on).agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.sum("c").alias("v"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("kinds") == 1, 1.0).otherwise(0.0)).alias("ipr"), F.avg(F.when(F.col("v") > 1, F.col("same") / (F.col("v") * (F.col("v") - 1)))).alias("par"))


def run_summary(responses: DataFrame, published: DataFrame, *by: str, key: str = "frame_id") -> DataFrame:
    """by, headline rates, n, cost_usd and latency_ms summed over all answers, status_counts as a map, and over ok answers
    whose frame has a published label: n_comparable, hands_agreement, labor_agreement (0 where there are none).

    responses: hands_visible, manipulation, status, cost_usd, latency_ms; published: hand_count, active_labor by key."""
    ok = F.col("status") == "ok"
    both = responses.join(published.select(key, "hand_count", "active_labor", F.lit(True).alias("_p")), key, "left")
    of = ok & F.col("_p")
    rate = lambda c: F.coalesce(F.avg(F.when(of, F.when(c, 1.0).otherwise(0.0))), F.lit(0.0))
    sums = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.coalesce(F.sum("latency_ms"), F.lit(0)).cast("long").alias("latency_ms"), F.count_if(of).alias("n_comparable"),
        rate(F.col("hands_visible") == F.col("hand_count")).alias("hands_agreement"), rate(F.col("manipulation") == F.col("active_labor")).alias("labor_agreement"),
    )
    statuses = responses.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "_n")))).alias("status_counts"))
    rates = headline_rates(responses, *by).select(*by, "n_ok", "at_least_one", "two_hands", "manipulation")
    return rates.join(sums, list(by)).join(statuses, list(by))
