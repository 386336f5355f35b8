"""Power and precision simulations, one row a simulated study, in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.scalars import Z95
from assayer.functions.vocab import SEED


def two_proportion_power(spark: SparkSession, baselines: list[float], n: int, effect: float, sims: int, seed: int = SEED) -> DataFrame:
    """baseline, power: how often two arms of n whose rates differ by `effect` are told apart by a two-sided z test."""
    grid = spark.createDataFrame([(b,) for b in baselines], "baseline double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for b in g["baseline"]:
                rng = np.random.default_rng([seed, int(round(b * 1e9))])
                x, y = rng.binomial(n, b, sims), rng.binomial(n, b + effect, sims)
                pooled = (x + y) / (2 * n)
                se = np.sqrt(pooled * (1 - pooled) * 2 / n)
                z = np.divide(np.abs(x - y) / n, se, out=np.zeros(sims), where=se > 0)
                yield pd.DataFrame({"baseline": [b], "power": [float((z > Z95).mean())]})

    return grid.mapInPandas(run, "baseline double, power double")


def binary_ac1(p: float, q: float, both: float) -> float:
    """AC1 of two binary raters with positive rates p and q that agree with probability both."""
    pi = (p + q) / 2
    chance = 2 * pi * (1 - pi)
    return 1.0 if chance >= 1 else (both - chance) / (1 - chance)


def match_rate_for_ac1(target: float, prevalence: float, tolerance: float = 1e-9) -> float:
    """The agreement rate at which raters of one prevalence reach the target AC1, by bisection."""
    lo, hi = 0.0, 1.0
    while hi - lo > tolerance:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binary_ac1(prevalence, prevalence, mid) < target else (lo, mid)
    return (lo + hi) / 2


def ac1_precision(spark: SparkSession, truths: list[float], prevalence: float, n: int, bar: float, sims: int, seed: int = SEED) -> DataFrame:
    """true_ac1, p_reached: how often n pairs measure at least `bar`. An estimate without a defined chance level counts 0 unless perfect."""
    rates = [(t, match_rate_for_ac1(t, prevalence)) for t in truths]
    grid = spark.createDataFrame(rates, "true_ac1 double, rate double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for t, rate in zip(g["true_ac1"], g["rate"], strict=True):
                rng = np.random.default_rng([seed, int(round(t * 1e9))])
                off = (1 - rate) / 2
                counts = rng.multinomial(n, [max(prevalence - off, 0), off, off, max(1 - prevalence - off, 0)], sims) / n
                pi = counts[:, 0] + (counts[:, 1] + counts[:, 2]) / 2
                chance = 2 * pi * (1 - pi)
                raw = counts[:, 0] + counts[:, 3]
                ac1 = np.where(chance >= 1, np.where(raw == 1, 1.0, 0.0), (raw - chance) / np.maximum(1 - chance, 1e-12))
                yield pd.DataFrame({"true_ac1": [t], "p_reached": [float((ac1 >= bar).mean())]})

    return grid.mapInPandas(run, "true_ac1 double, p_reached double").orderBy(F.col("true_ac1"))
