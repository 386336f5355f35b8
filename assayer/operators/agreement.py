"""Agreement statistics from conditional sums over pairs; every statistic takes grouping columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def _share(condition: Column, weight: Column | None = None) -> Column:
    if weight is None:
        return F.avg(F.when(condition, 1.0).otherwise(0.0))
    return F.sum(F.when(condition, weight).otherwise(0)) / F.sum(weight)


def cells(pairs: DataFrame, a: str, b: str, space: tuple, by: list[str], weight: Column | None = None) -> DataFrame:
    """One row a group: n, raw agreement, and the marginals pa_i, pb_i over the fixed category space. A row stands for
    as many pairs as its weight says."""
    marginals = [_share(F.col(c) == v, weight).alias(f"p{c_}_{i}") for c_, c in (("a", a), ("b", b)) for i, v in enumerate(space)]
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return pairs.groupBy(*by).agg(n.alias("n"), _share(F.col(a) == F.col(b), weight).alias("raw"), *marginals)


def _corrected(expected: Column) -> Column:
    """(raw - expected) / (1 - expected), 1 where chance alone agrees."""
    return F.when(expected >= 1, 1.0).otherwise((F.col("raw") - expected) / (1 - expected))


def agreement(pairs: DataFrame, a: str, b: str, space: tuple, *by: str, weight: Column | None = None) -> DataFrame:
    """by, n, raw, ac1 (Gwet), kappa (Cohen). No row for a group without pairs."""
    q = len(space)
    pi = [(F.col(f"pa_{i}") + F.col(f"pb_{i}")) / 2 for i in range(q)]
    chance_ac1 = _total([p * (1 - p) for p in pi]) / (q - 1)
    chance_kappa = _total([F.col(f"pa_{i}") * F.col(f"pb_{i}") for i in range(q)])
    return cells(pairs, a, b, space, list(by), weight).select(*by, "n", "raw", _corrected(chance_ac1).alias("ac1"), _corrected(chance_kappa).alias("kappa"))


def marginals(pairs: DataFrame, column: str, space: tuple, *by: str) -> DataFrame:
    """Share of each category of the fixed space, absent ones 0."""
    return pairs.groupBy(*by).agg(*[_share(F.col(column) == v).alias(f"p_{v}".lower()) for v in space])


def fleiss_kappa(complete: DataFrame, value: str, space: tuple, on: str = "frame_id", *by: str) -> DataFrame:
    """by, n_frames, k, fleiss over frames that every judge answered."""
    per = complete.groupBy(*by, on).agg(F.count(F.lit(1)).alias("k"), *[F.sum(F.when(F.col(value) == v, 1).otherwise(0)).alias(f"c{i}") for i, v in enumerate(space)])
    squares = _total([F.col(f"c{i}") * F.col(f"c{i}") for i in range(len(space))])
    per = per.withColumn("p", (squares - F.col("k")) / (F.col("k") * (F.col("k") - 1)))
    sums = per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_frames"), F.max("k").alias("k"), F.avg("p").alias("raw"), *[(F.sum(f"c{i}") / F.sum("k")).alias(f"s{i}") for i in range(len(space))])
    expected = _total([F.col(f"s{i}") * F.col(f"s{i}") for i in range(len(space))])
    return sums.select(*by, "n_frames", "k", _corrected(expected).alias("fleiss"))


def error_dependence(gold: DataFrame, responses: DataFrame, truth: str, answer: str, *by: str) -> DataFrame:
    """by, n_pairs, phi: the mean phi of two judges' errors over judge pairs with common frames.
    A pair without spread in one judge's errors counts 0; a pair without common frames is left out."""
    errors = gold.join(responses.where("status = 'ok'"), ["frame_id", *by]).select(*by, "frame_id", "judge", (F.col(answer) != F.col(truth)).cast("int").alias("e"))
    other = errors.withColumnsRenamed({"judge": "judge_b", "e": "f"})
    both = errors.join(other, [*by, "frame_id"]).where("judge < judge_b")
    c = both.groupBy(*by, "judge", "judge_b").agg(F.sum(F.col("e") * F.col("f")).alias("n11"), F.sum("e").alias("n1"), F.sum("f").alias("m1"), F.count(F.lit(1)).alias("n"))
    # Products of four counts leave 64 bits at some 100,000 frames, those of two at some 3 billion.
    real, exact = (lambda c: F.col(c).cast("double")), (lambda c: F.col(c).cast("decimal(19,0)"))
    spread = F.sqrt(real("n1") * real("m1") * (real("n") - real("n1")) * (real("n") - real("m1")))
    covered = (exact("n") * exact("n11") - exact("n1") * exact("m1")).cast("double")
    phi = F.when(spread > 0, covered / spread).otherwise(0.0)
    return c.withColumn("phi", phi).groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("phi").alias("phi"))


def confusion(pairs: DataFrame, judge: str, rater: str, *by: str) -> DataFrame:
    """by, judge answer, rater answer, n."""
    return pairs.groupBy(*by, F.col(judge).alias("judge_answer"), F.col(rater).alias("rater_answer")).agg(F.count(F.lit(1)).alias("n"))


def error_direction(pairs: DataFrame, judge: str, rater: str, top: int, *by: str) -> DataFrame:
    """How often the judge says more or less than the rater, of the rows where it could."""
    j, r = F.col(judge).cast("int"), F.col(rater).cast("int")
    return pairs.groupBy(*by).agg(
        F.count_if(j > r).alias("over"), F.count_if(r < top).alias("can_over"), F.count_if(j < r).alias("under"), F.count_if(r > 0).alias("can_under"), F.count_if((r == 1) & (j == 2)).alias("one_to_two")
    )


def error_rate_gap(pairs: DataFrame, judge: str, rater: str, arm: str, left: str, right: str) -> DataFrame:
    """Error rates of two arms, their difference in points, and whether it reaches the domain-bias limit."""
    from assayer.functions.vocab import DOMAIN_BIAS_PP

    wrong = F.when(F.col(judge) != F.col(rater), 1.0).otherwise(0.0)
    rates = pairs.agg(F.avg(F.when(F.col(arm) == left, wrong)).alias("left_error"), F.avg(F.when(F.col(arm) == right, wrong)).alias("right_error"))
    gap = (F.col("right_error") - F.col("left_error")) * 100
    return rates.select("left_error", "right_error", gap.alias("gap_pp"), (F.abs(gap) >= DOMAIN_BIAS_PP).alias("biased"))


def retest_separation(timed: DataFrame, at: str = "labelled_at") -> DataFrame:
    """Days between the passes: n, least, median, most, how many reach the wanted gap, how many are inverted."""
    from assayer.functions.scalars import days_between
    from assayer.functions.vocab import RETEST_DAYS

    d = days_between(F.col(at), F.col(f"re_{at}"))
    return timed.agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("least"), F.median(d).alias("median"), F.max(d).alias("most"), F.count_if(d >= RETEST_DAYS).alias("apart"), F.count_if(d < 0).alias("inverted"))


def self_agreement(repeats: DataFrame, value: str, on: str = "frame_id") -> DataFrame:
    """Share of frames whose repeats all gave one answer (all missing counts as one)."""
    per = repeats.groupBy(on).agg((F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))).alias("kinds"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("kinds") == 1, 1.0).otherwise(0.0)).alias("agreement"))


def all_slices(rows: DataFrame, said: str, truth: str, *by: str) -> DataFrame:
    """by, level, n, tp, fp, fn, tn, accuracy of two boolean columns for every subset of by at once; a column that a slice
    does not hold fast is null, and level tells that null from one in the data (bit i from the right: the i-th last of by)."""
    s, t = F.col(said), F.col(truth)
    counts = {"tp": s & t, "fp": s & ~t, "fn": ~s & t, "tn": ~s & ~t}
    found = rows.where(s.isNotNull() & t.isNotNull()).cube(*by).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    return found.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n"))
