"""Deterministic sampling: draws are orders by md5 of seed, sample name and key, so any engine repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scalars import draw, hash_order


def running(df: DataFrame, bucket: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds a running sum (itself included) over the whole table in the order (bucket, order). Buckets are summed
    first and their few totals accumulated, so the long windows stay within a bucket."""
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy("_bucket").agg(F.sum(value).alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(F.broadcast(totals.select("_bucket", before.alias("_before"))), "_bucket").withColumn(name, F.col("_before") + F.sum(value).over(w)).drop("_bucket", "_before")


def running_within(df: DataFrame, by: list[str], bucket: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds name, a running sum (itself included) within the group, and name_all, the group's sum, in the order (bucket,
    order). A group's buckets are summed first, so no task takes a whole group; null groups are groups."""
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = df.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_t"))
    group = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("_t").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_in"), earlier.alias("_before"), F.sum("_t").over(group).alias(f"{name}_all"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)] + [F.col("_bucket").eqNullSafe(F.col("_in"))]
    w = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(totals, same).withColumn(name, F.col("_before") + F.sum("_value").over(w))
    return out.drop("_bucket", "_value", "_in", "_before", *[f"_by{i}" for i in range(len(by))])


def ranked(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the rank from 1 in the order of one whole-number or string column, nulls first."""
    if df.schema[order].dataType.simpleString() == "string":
        return running(df, F.coalesce(F.substring(order, 1, 3), F.lit("")), [F.col(order)], F.lit(1), name)
    ends = df.agg(F.min(order).cast("double").alias("_min"), F.max(order).cast("double").alias("_max"))
    place = F.floor((F.col(order).cast("double") - F.col("_min")) / F.nullif(F.col("_max") - F.col("_min"), F.lit(0.0)) * 4096)
    bucket = F.when(F.col(order).isNull(), -1).otherwise(F.coalesce(place, F.lit(0)))
    return running(df.crossJoin(F.broadcast(ends)), bucket, [F.col(order)], F.lit(1), name).drop("_min", "_max")


def hash_bucket(name: str, key: Column) -> Column:
    """4,096 buckets by the draw order."""
    return F.substring(hash_order(name, key), 1, 3)


def uniform(pool: DataFrame, name: str, n: int, key: str = "frame_id") -> DataFrame:
    """Exactly n rows (or all) without replacement: the first n by hash, as a top-n without a full sort."""
    return pool.orderBy(hash_order(name, F.col(key)), key).limit(n)


def take_all(pool: DataFrame, n: int, key: str = "frame_id") -> DataFrame:
    return pool.orderBy(key).limit(n)


def from_parents(parents: list[DataFrame], name: str, n: int, key: str = "frame_id") -> DataFrame:
    pool = parents[0]
    for p in parents[1:]:
        pool = pool.unionByName(p)
    return uniform(pool, name, n, key)


def one_per(pool: DataFrame, name: str, group: list[str], key: str = "frame_id") -> DataFrame:
    """One hashed row of each group."""
    w = Window.partitionBy(*group).orderBy(hash_order(name, F.col(key)), F.col(key))
    return pool.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def apportion(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Adds alloc by largest remainder, ties by key; all zero where the weights sum to zero."""
    everyone = Window.partitionBy(F.lit(0))
    share = F.when(F.sum(weight).over(everyone) > 0, F.col(weight) * total / F.sum(weight).over(everyone)).otherwise(F.lit(0.0))
    w = weights.withColumn("_share", share).withColumn("_floor", F.floor("_share").cast("long"))
    left = F.when(F.sum(weight).over(everyone) > 0, F.lit(total) - F.sum("_floor").over(everyone)).otherwise(0)
    rank = F.row_number().over(everyone.orderBy(F.desc(F.col("_share") - F.col("_floor")), key))
    return w.withColumn("alloc", F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).drop("_share", "_floor")


def stratified(pool: DataFrame, name: str, n: int, stratum: str, weights: DataFrame, weight: str, clip: list[str], key: str = "frame_id") -> DataFrame:
    """One row a clip, then each stratum's share of n by hash; a stratum with too few rows gives what it has."""
    alloc = apportion(weights, stratum, weight, n).select(stratum, "alloc")
    w = Window.partitionBy(stratum).orderBy(hash_order(name, F.col(key)), F.col(key))
    rows = one_per(pool, name, clip, key).withColumn("_r", F.row_number().over(w)).join(alloc, stratum)
    return rows.where(F.col("_r") <= F.col("alloc")).drop("_r", "alloc")


def by_weight(items: DataFrame, name: str, n: int, weight: str, key: str) -> DataFrame:
    """n hashed draws with replacement in proportion to whole weights; a place (item, offset inside
    it) that is drawn again keeps its first draw. The draws, not the items, are matched by bucket of 1/4,096 of the
    weight, so neither side is broadcast nor scanned by the other."""
    span = items.select(key, F.col(weight).cast("long").alias("_w")).where("_w > 0")
    span = running(span, hash_bucket(name, F.col(key)), [F.col(key)], F.col("_w"), "_hi").withColumn("_lo", F.col("_hi") - F.col("_w"))
    total = span.agg(F.max("_hi").alias("_total"))
    points = items.sparkSession.range(n).withColumnRenamed("id", "_i").crossJoin(F.broadcast(total)).select("_i", draw(name, F.col("_total"), F.col("_i")).alias("_u"))
    width = F.greatest(F.ceil(F.col("_total") / 4096), F.lit(1)).cast("long")
    points = points.crossJoin(F.broadcast(total)).withColumn("_at", F.floor(F.col("_u") / width))
    span = span.crossJoin(F.broadcast(total)).select(key, "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))).alias("_at"))
    hit = points.join(span, "_at").where("_u >= _lo and _u < _hi")
    return hit.groupBy(key, (F.col("_u") - F.col("_lo")).alias("offset")).agg(F.min("_i").alias("draw")).select(key, "draw", "offset")


def split(pool: DataFrame, name: str, sizes: dict[str, int], key: str = "frame_id") -> DataFrame:
    """Disjoint parts by one hashed order: the first sizes[a] rows are a, the next sizes[b] b."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(hash_order(name, F.col(key)), F.col(key)))
    part, at = None, 0
    for label, n in sizes.items():
        here = (F.col("_r") > at) & (F.col("_r") <= at + n)
        part, at = (F.when(here, label) if part is None else part.when(here, label)), at + n
    first = uniform(pool, name, at, key)
    return first.withColumn("_r", rank).withColumn("part", part).drop("_r")


def replace_undecodable(members: DataFrame, reserve: DataFrame, bad: Column, key: str = "frame_id", position: str = "position") -> DataFrame:
    """The k-th bad member is replaced by the k-th reserve; running out raises."""
    spare = ranked(reserve, position, "_k").select(F.col(key).alias("_spare"), "_k")
    broken = ranked(members.where(bad), position, "_k").join(spare, "_k", "left")
    fixed = broken.where(F.assert_true(F.col("_spare").isNotNull(), "the reserve is used up").isNull()).withColumn(key, F.col("_spare")).drop("_spare", "_k")
    return members.where(~bad).unionByName(fixed.select(*members.columns))


def interleave(arms: DataFrame, arm: str, name: str, key: str = "frame_id") -> DataFrame:
    """Adds position so that every prefix has about the arms' shares: by rank / size within the arm."""
    arms = running_within(arms, [arm], hash_bucket(name, F.col(key)), [hash_order(name, F.col(key)), F.col(key)], F.lit(1), "_r")
    place = (F.col("_r") - 1) / F.col("_r_all")
    return running(arms.withColumn("_p", place), F.floor(F.col("_p") * 4096), [F.col("_p"), F.col(arm), F.col(key)], F.lit(1), "position").drop("_p", "_r", "_r_all")
