"""Bootstrap intervals from sufficient statistics: resamples are multinomial counts of cells or clusters, never rows.

Intervals come from the tree of binomial splits (multinomial.py), whose draws
take bounded steps and meet no join per draw; cell_draws lists the counts of a
few cells, a row for each cell and resample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalars import binomial, draw
from assayer.operators.multinomial import ac1_intervals, clustered_interval, mean_interval, seed_of

MAX_CELLS = 256


def cluster_interval(rows: DataFrame, value: str, cluster: str, name: str, resamples: int, level: float = 0.95) -> DataFrame:
    """lo, hi: interval of the mean by resampling whole clusters; name seeds the draws."""
    return clustered_interval(rows, value, cluster, [], resamples, level, seed_of(name))


def cell_draws(cells: DataFrame, values: list[str], count: str, name: str, resamples: int) -> DataFrame:
    """b, the values of a cell and _drawn, how often resample b draws it: as many draws with replacement as the cells
    stand for rows. A cell's draws are hashed by its values, so cells without rows change nothing. The cells, at most MAX_CELLS, are read to the driver; more raise."""
    found = cells.orderBy(*values).limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} distinct values: resample clusters instead")
    total = sum(c[count] for c in found)
    drawn, left = cells.sparkSession.range(resamples).select(F.col("id").alias("b"), F.lit(total).cast("long").alias("_left")), total
    for i, c in enumerate(found):
        u = draw(name, F.lit(1 << 48), F.col("b"), F.lit("/".join(str(c[v]).lower() for v in values))) / float(1 << 48)
        k = binomial(u, F.col("_left"), c[count] / left) if c[count] < left else F.col("_left")
        drawn, left = drawn.withColumn(f"_k{i}", k).withColumn("_left", F.col("_left") - F.col(f"_k{i}")), left - c[count]
    kinds = {v: cells.schema[v].dataType for v in values}
    rows = F.array(*[F.struct(*[F.lit(c[v]).cast(kinds[v]).alias(v) for v in values], F.col(f"_k{i}").alias("_drawn")) for i, c in enumerate(found)])
    return drawn.select("b", F.inline(rows)).where("_drawn > 0") if found else drawn.select("b", *[F.lit(None).cast(kinds[v]).alias(v) for v in values], F.lit(0).cast("long").alias("_drawn")).where("false")


def iid_interval(rows: DataFrame, value: str, name: str, resamples: int, level: float = 0.95) -> DataFrame:
    """lo, hi: interval of the mean of a column by resampling rows, whatever its number of distinct values."""
    return mean_interval(rows, value, [], resamples, level, seed_of(name))


def ac1_interval(pairs: DataFrame, a: str, b: str, space: tuple, name: str, resamples: int, level: float = 0.95) -> DataFrame:
    """lo, hi: interval of AC1 recomputed on each resample of pairs."""
    return ac1_intervals(pairs, a, b, space, [], resamples, level, seed_of(name))


def design_effect(clustered: DataFrame, iid: DataFrame) -> DataFrame:
    """(clustered width / iid width) squared; null where the iid width is 0."""
    both = clustered.select(F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi")).crossJoin(iid.select(F.col("lo").alias("i_lo"), F.col("hi").alias("i_hi")))
    width: Column = F.col("i_hi") - F.col("i_lo")
    return both.withColumn("design_effect", F.when(width > 0, F.pow((F.col("c_hi") - F.col("c_lo")) / width, F.lit(2))))


def cluster_sizes(rows: DataFrame, cluster: str) -> DataFrame:
    per = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.count(F.lit(1)).alias("clusters"), F.sum("_n").alias("observations"), F.avg("_n").alias("mean"), F.min("_n").alias("least"), F.max("_n").alias("most"))


def implied_icc(deff: Column, mean_size: Column) -> Column:
    return (deff - 1) / (mean_size - 1)


def implications(deff: Column, mean_size: Column) -> dict[str, Column]:
    """What a design effect says: icc, the correlation inside clusters of that mean size; width_excess, how much wider the
    clustered interval is; understated, the share of its width that an iid interval leaves out. Null for no design effect."""
    root = F.sqrt(deff)
    return {"icc": F.when(mean_size > 1, implied_icc(deff, mean_size)), "width_excess": root - 1, "understated": F.when(deff > 0, 1 - 1 / root)}
