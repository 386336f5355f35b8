"""Resamples with replacement of any number of cells: multinomial counts by binomial splits down a tree.

A resample of n rows draws each distinct value a multinomial number of times.
The cells of a group are ranked and stand at the leaves of a binary tree; the n
draws start at the root, and at a node with w rows below, w' of them on the left,
a binomial number of its draws with p = w' / w goes left. A binomial draw takes a
bounded number of steps whatever n is: up to FEW draws are made one by one, rarer
events by their waiting times, all others by transformed rejection (Hoermann 1993).

Levels go twelve at a time: a node with up to FAN children is a row with its
draws in every resample, met by its children's weights in one task, so a task
holds FAN cells and B numbers, and nothing is joined per draw. Draws are hashes
of (resample, height, node): equal ranks give equal draws in every group, run and
engine, so groups with the same cells share their resamples.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import vocab
from assayer.sources.shared import stored

BITS = 12
FAN = 1 << BITS
FEW, ATTEMPTS, WAITS = 64, 32, 96
_CHUNK = 256
#: Draws that are made at once: few enough that their numbers stay in a core's cache.
_BLOCK = 1 << 15


def _word(x: int) -> np.uint32:
    return np.uint32(x & 0xFFFFFFFF)


def _scramble(x: np.ndarray) -> np.ndarray:
    """32 bits of which each depends on all of x's; products keep their low 32 bits."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x ^ (x >> np.uint32(16))


def _key(seed: int, b: np.ndarray, height: int, node: np.ndarray) -> np.ndarray:
    key = _scramble(np.asarray(b).astype(np.uint32) + _word(seed * 65_537))
    key = _scramble(key + _word(height * 1_000_003))
    return _scramble(key ^ np.asarray(node).astype(np.uint32))


def _uniform(key: np.ndarray, i: int) -> np.ndarray:
    return (_scramble(key + _word((i + 1) * 7_919)) + 0.5) / 4294967296.0


_EXACT = np.array([math.lgamma(i + 1) for i in range(32)])


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = np.maximum(n.astype(np.float64), 1)
    series = (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * (x * x * x)) + 1 / (1260 * (x * x * x * x * x))
    return np.where(n < 32, _EXACT[np.clip(n, 0, 31)], series)


def _rejected(n: np.ndarray, p: np.ndarray, key: np.ndarray) -> np.ndarray:
    """n p >= 10 and p <= 1/2: the first accepted of up to ATTEMPTS proposals, or else the mode."""
    spread = np.sqrt(n * p * (1 - p))
    b = 1.15 + 2.53 * spread
    a, c, alpha, sure = -0.0873 + 0.0248 * b + 0.01 * p, n * p + 0.5, (2.83 + 5.1 / b) * spread, 0.92 - 4.2 / b
    mode = np.floor((n + 1) * p).astype(np.int64)
    out, open_ = mode.copy(), np.arange(len(n))
    for t in range(ATTEMPTS):
        if not len(open_):
            break
        o = open_
        u, v = _uniform(key[o], 2 * t) - 0.5, _uniform(key[o], 2 * t + 1)
        us = 0.5 - np.abs(u)
        k = np.floor((2 * a[o] / us + b[o]) * u + c[o]).astype(np.int64)
        inside = (k >= 0) & (k <= n[o])
        take = inside & (us >= 0.07) & (v <= sure[o])
        ask = np.flatnonzero(inside & ~take)  # some one in eight needs the exact weights
        d, us, k_ = o[ask], us[ask], k[ask]
        top, odds = _log_factorial(mode[d]) + _log_factorial(n[d] - mode[d]), np.log(p[d] / (1 - p[d]))
        take[ask] = np.log(v[ask] * alpha[d] / (a[d] / (us * us) + b[d])) <= top - _log_factorial(k_) - _log_factorial(n[d] - k_) + (k_ - mode[d]) * odds
        out[o[take]] = k[take]
        open_ = o[~take]
    return out


def _waited(n: np.ndarray, p: np.ndarray, key: np.ndarray) -> np.ndarray:
    """n p < 10: how many waiting times between successes fit into n trials."""
    at, k, rate = np.zeros(len(n)), np.zeros(len(n), np.int64), np.log1p(-p)
    for i in range(WAITS):
        at += np.floor(np.log(_uniform(key, i)) / rate) + 1
        if not (at <= n).any():
            break
        k += at <= n
    return k


def binomial(n: np.ndarray, p: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A draw of n trials of probability p for each key."""
    out = np.where(p >= 1, n, 0).astype(np.int64)
    some = (n > 0) & (p > 0) & (p < 1)
    few = np.flatnonzero(some & (n <= FEW))
    left, chance, own = n[few], p[few], key[few]
    won = np.zeros(len(few), np.int64)
    for i in range(int(left.max(initial=0))):
        more = left > i
        if np.count_nonzero(more) < 0.7 * len(more):
            out[few] = won
            few, left, chance, own, won = few[more], left[more], chance[more], own[more], won[more]
            more = True
        won += (_uniform(own, i) < chance) & more
    out[few] = won
    many = np.flatnonzero(some & (n > FEW))
    flip = p[many] > 0.5
    q = np.where(flip, 1 - p[many], p[many])
    rare = n[many] * q < 10
    k = np.zeros(len(many), np.int64)
    for part, draw in ((rare, _waited), (~rare, _rejected)):
        k[part] = draw(n[many][part], q[part], key[many][part])
    out[many] = np.where(flip, n[many] - k, k)
    return out


def split(weights: np.ndarray, draws: np.ndarray, first: int, base: int, seed: int, resample: int = 0) -> np.ndarray:
    """(resamples, children) draws of a node's children: weights in the order of their numbers first, first + 1, ... at height base."""
    full = np.zeros(FAN, np.int64)
    full[: len(weights)] = weights
    levels = [full]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    b = np.arange(resample, resample + len(draws))
    now = draws.reshape(-1, 1)
    for up in range(BITS, 0, -1):
        below, here = levels[up - 1], levels[up]
        live = np.flatnonzero(here)
        node = (first >> up) + live
        p = np.divide(below[0::2][live], here[live])
        above, now = now, np.zeros((len(b), len(below)), np.int64)
        step = max(1, _BLOCK // max(1, len(live)))
        for x in range(0, len(b), step):
            n = above[x : x + step, live] if len(live) < len(here) else above[x : x + step]
            key = _key(seed, b[x : x + step, None], base + up, node[None, :])
            left = binomial(n.ravel(), np.broadcast_to(p, n.shape).ravel(), key.ravel()).reshape(n.shape)
            now[x : x + step, 2 * live], now[x : x + step, 2 * live + 1] = left, n - left
    return now[:, : len(weights)]


def _groups(df: DataFrame, by: list[str], order: list[str], parts: int) -> DataFrame:
    """df with _rank, the place from 0 within the group: by ranges of the order, so that no task ranks a whole group."""
    keys = [F.col(c) for c in [*by, *order]]
    dealt = stored(df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()), "ranked-cells")
    sizes = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*by, "_range", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))  # a row for each group and range
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*[F.col(c) for c in order]))
    match = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] + [F.col("l._range") == F.col("r._range")]
    joined = dealt.alias("l").join(before.alias("r"), match)
    return joined.select("l.*", "r._before").withColumn("_rank", F.col("_before") + inside - 1).drop("_range", "_before")


def _longs(values: np.ndarray) -> bytes:
    return values.astype("<i8").tobytes()


def resample_sums(cells: DataFrame, by: list[str], order: list[str], weight: str, payload: list[str], resamples: int, draws: Column | None = None, seed: int = vocab.SEED) -> DataFrame:
    """by, b, payload: for each group and resample b the payload of its cells, each times as often as the resample draws it.

    A group's cells are told by order; weight, a whole number, is how many rows a cell stands for; the draws of a group
    are as many as its rows, or those that draws (an aggregate over the group's cells) gives. Cells without weight are
    never drawn, and a group of such cells alone has no resamples. A null in payload counts as 0."""
    spark = cells.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    live = cells.where(F.col(weight) > 0).select(*by, *order, F.col(weight).cast("long").alias("_w"), *[F.col(c).cast("double").alias(c) for c in payload if c not in by + order])
    live = stored(_groups(live, by, order, parts).withColumn("_group", F.struct(F.lit(0), *by)), "cells")
    totals = live.groupBy("_group").agg((draws if draws is not None else F.sum("_w")).cast("long").alias("_draws"), F.max("_rank").alias("_last"))
    found = totals.agg(F.max("_last").alias("last"), F.sum(F.shiftright("_last", BITS) + 1).alias("nodes")).first()
    last, parts = found["last"] or 0, min(parts, found["nodes"] or 1)
    # Few bytes make much work here, so nodes are dealt by number: partitions merged by size would leave it to a few tasks.
    nodes = lambda df: df.repartition(parts, "_group", "_node").groupBy("_group", "_node")
    tiers = 1
    while last >> (BITS * tiers):
        tiers += 1
    node = lambda t: F.shiftright("_rank", BITS * t).alias("_node")
    start = F.udf(lambda n: bytearray(_longs(np.full(resamples, n))), "binary")
    held = totals.select("_group", F.lit(0).cast("long").alias("_node"), start("_draws").alias("_at"))
    kind = live.schema["_group"].dataType.simpleString()

    def children(t: int):
        def run(parents: pa.Table, below: pa.Table) -> pa.Table:
            below = below.sort_by("_child")
            number = below.column("_child").to_numpy()
            all_draws = np.frombuffer(parents.column("_at")[0].as_py(), "<i8")
            w = np.zeros(int(number[-1] % FAN) + 1, np.int64)
            w[number % FAN] = below.column("_w").to_numpy()
            got = np.concatenate([split(w, all_draws[x : x + _CHUNK], int(number[0]) // FAN * FAN, BITS * t, seed, x) for x in range(0, resamples, _CHUNK)])
            return pa.table({"_group": below.column("_group"), "_node": pa.array(number), "_at": pa.array([_longs(got[:, i]) for i in number % FAN], pa.binary())})

        return run

    for t in range(tiers - 1, 0, -1):
        below = live.groupBy("_group", F.shiftright("_rank", BITS * t).alias("_child")).agg(F.sum("_w").alias("_w")).withColumn("_node", F.shiftright("_child", BITS))
        held = nodes(held).cogroup(nodes(below)).applyInArrow(children(t), f"_group {kind}, _node long, _at binary")

    def leaves(parents: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("_rank")
        rank = own.column("_rank").to_numpy()
        all_draws, w = np.frombuffer(parents.column("_at")[0].as_py(), "<i8"), own.column("_w").to_numpy()
        values = np.column_stack([pc.fill_null(own.column(f"_p{i}"), 0.0).to_numpy() for i in range(len(payload))])
        sums = np.concatenate([split(w, all_draws[x : x + _CHUNK], int(rank[0]), 0, seed, x) @ values for x in range(0, resamples, _CHUNK)])
        group = own.column("_group").combine_chunks().take(pa.array(np.zeros(resamples, np.int64)))
        return pa.table({"_group": group, "b": pa.array(np.arange(resamples)), **{f"_p{i}": pa.array(sums[:, i]) for i in range(len(payload))}})

    rows = live.select("_group", "_rank", node(1), "_w", *[F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(payload)])
    columns = ", ".join(f"_p{i} double" for i in range(len(payload)))
    found = nodes(held).cogroup(nodes(rows)).applyInArrow(leaves, f"_group {kind}, b long, {columns}")
    return found.groupBy("_group", "b").agg(*[F.sum(f"_p{i}").alias(f"_s{i}") for i in range(len(payload))]).select(*[F.col(f"_group.{c}").alias(c) for c in by], "b", *[F.col(f"_s{i}").alias(c if c not in by else f"{c}_sum") for i, c in enumerate(payload)])


def _interval(means: DataFrame, by: list[str], level: float) -> DataFrame:
    q = F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return means.groupBy(*by).agg(q.alias("_q")).select(*by, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def seed_of(name: str) -> int:
    """A seed for the draws of a named result."""
    return zlib.crc32(f"{vocab.SEED}:{name}".encode())


def mean_interval(rows: DataFrame, value: str, by: list[str], resamples: int = vocab.RESAMPLES, level: float = 0.95, seed: int = vocab.SEED) -> DataFrame:
    """by, lo, hi: percentile interval of the mean of a number column by resampling rows; nulls take no part."""
    cells = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k")).withColumn("_one", F.lit(1.0))
    sums = resample_sums(cells.withColumn("_x", F.col("_v")), by, ["_v"], "_k", ["_x", "_one"], resamples, seed=seed)
    return _interval(sums.withColumn("m", F.col("_x") / F.col("_one")), by, level)


def clustered_interval(rows: DataFrame, value: str, cluster: str, by: list[str], resamples: int = vocab.RESAMPLES, level: float = 0.95, seed: int = vocab.SEED) -> DataFrame:
    """by, lo, hi: percentile interval of the mean by resampling whole clusters; nulls take no part."""
    stats = rows.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_one"))
    sums = resample_sums(stats, by, [cluster], "_one", ["_s", "_n"], resamples, seed=seed)
    return _interval(sums.withColumn("m", F.col("_s") / F.col("_n")), by, level)


def design_effects(rows: DataFrame, tasks: DataFrame, value: str, cluster: str, task: str = "task", resamples: int = vocab.RESAMPLES) -> DataFrame:
    """A row for each of tasks: n, clusters, point, both intervals, design_effect, why_absent.

    design_effect is (clustered width / iid width) squared and null where the iid width is 0; a task without values keeps
    its row, with nulls and the reason."""
    have = rows.where(F.col(value).isNotNull())
    point = have.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(cluster)).alias("clusters"), F.avg(F.col(value).cast("double")).alias("point"))
    named = lambda df, p: df.select(task, F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"))
    both = named(mean_interval(have, value, [task], resamples), "iid").join(named(clustered_interval(have, value, cluster, [task], resamples), "cluster"), task)
    out = tasks.select(task).join(point.join(both, task), task, "left")
    width = F.col("iid_hi") - F.col("iid_lo")
    effect = F.when(width > 0, F.pow((F.col("cluster_hi") - F.col("cluster_lo")) / width, F.lit(2)))
    return out.withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "design_effect": effect, "why_absent": F.when(F.col("n").isNull(), "no answers that are ok for this task")})


def ac1_intervals(pairs: DataFrame, a: str, b: str, space: tuple, by: list[str], resamples: int = vocab.RESAMPLES, level: float = 0.95, seed: int = vocab.SEED) -> DataFrame:
    """by, lo, hi: interval of AC1, recomputed on resamples of the pairs; pairs with a null answer take no part."""
    half = lambda k: ((F.col(a) == k).cast("double") + (F.col(b) == k).cast("double")) / 2
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("_k"))
    payload = {"_same": (F.col(a) == F.col(b)).cast("double"), "_one": F.lit(1.0)} | {f"_h{i}": half(k) for i, k in enumerate(space)}
    sums = resample_sums(cells.withColumns(payload), by, [a, b], "_k", list(payload), resamples, seed=seed)
    share = [F.col(f"_h{i}") / F.col("_one") for i in range(len(space))]
    chance = sum((p * (1 - p) for p in share), F.lit(0.0)) / (len(space) - 1)
    raw = F.col("_same") / F.col("_one")
    return _interval(sums.withColumn("m", F.when(chance >= 1, 1.0).otherwise((raw - chance) / (1 - chance))), by, level)
