"""Comparisons of tables and texts, missing rows, quantiles by rank, spans, slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.sampling import ranked, running_within


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_a, n_b, only_a, only_b, identical: rows counted with their repeats, one pass over both tables."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = both.groupBy(*cols).agg(F.sum("_a").alias("x"), F.sum("_b").alias("y"))
    out = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((F.col("x"), "n_a"), (F.col("y"), "n_b"), (F.greatest(F.col("x") - F.col("y"), F.lit(0)), "only_a"), (F.greatest(F.col("y") - F.col("x"), F.lit(0)), "only_b"))])
    return out.withColumn("identical", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def missing_frames(expected: DataFrame, table: DataFrame, payload: str, on: str = "frame_id") -> DataFrame:
    """Expected ids that the table lacks or holds without a payload, with the reason."""
    there = table.groupBy(on).agg(F.max(F.coalesce(F.length(payload), F.lit(0))).alias("_size"))
    reason = F.when(F.col("_size").isNull(), "absent").when(F.col("_size") == 0, "empty payload")
    return expected.select(on).distinct().join(there, on, "left").select(on, reason.alias("reason")).where("reason is not null")


def exclusive_quantile(rows: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """The quantile at rank q (n + 1), between neighbours in proportion, ends held."""
    cells = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    ends = cells.agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    slot = F.coalesce(F.floor((F.col("_v") - F.col("_min")) / F.nullif(F.col("_max") - F.col("_min"), F.lit(0.0)) * 4096), F.lit(0))
    ranked = running_within(cells.crossJoin(F.broadcast(ends)), list(by), slot, [F.col("_v")], F.col("_k"), "_to")
    at = F.greatest(F.lit(1.0), F.least(F.col("_to_all").cast("double"), (F.col("_to_all") + 1) * q))
    here = lambda r: ((F.col("_to") - F.col("_k") < r) & (r <= F.col("_to"))).cast("double")
    weight = here(F.floor(at)) * (1 - (at - F.floor(at))) + here(F.floor(at) + 1) * (at - F.floor(at))
    return ranked.withColumn("_w", weight).where("_w > 0").groupBy(*by).agg(F.sum(F.col("_v") * F.col("_w")).alias("quantile"))


def shared_tags(declared: Column, referenced: Column) -> tuple[Column, Column]:
    """(declared but not referenced, referenced but not declared), sorted."""
    return F.array_sort(F.array_except(declared, referenced)), F.array_sort(F.array_except(referenced, declared))


def coalesce_spans(offsets: DataFrame, group: str, offset: str, width: int = 100) -> DataFrame:
    """group, start, length: sorted offsets joined greedily into spans of at most `width` from the span's start.

    A gap of width or more ends a span whatever came before, so a group falls into runs there, found block by block of
    offsets, and runs, not groups, are what one task takes; a run is passed over in sorted batches, a search a span."""
    known = offsets.where(F.col(group).isNotNull() & F.col(offset).isNotNull()).select(group, F.col(offset).cast("long").alias("_x")).distinct()
    known = known.withColumn("_block", F.floor(F.col("_x") / (width * 256)))
    blocks = known.groupBy(group, "_block").agg(F.max("_x").alias("_last"))
    before = blocks.select(group, (F.col("_block") + 1).alias("_block"), F.col("_last").alias("_earlier"))
    inside = Window.partitionBy(group, "_block").orderBy("_x")
    prior = F.coalesce(F.lag("_x").over(inside), F.col("_earlier"))
    begins = F.when(prior.isNull() | (F.col("_x") - prior >= width), F.col("_x"))
    marked = known.join(before, [group, "_block"], "left").withColumn("_run", F.max(begins).over(inside))
    # A block that starts inside a run goes on with the last run of the blocks before it.
    open_ = marked.groupBy(group, "_block").agg(F.max("_run").alias("_opened"))
    carried = open_.withColumn("_carried", F.max("_opened").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_opened")
    runs = marked.join(carried, [group, "_block"]).select(group, F.coalesce("_run", "_carried").alias("_run"), "_x")

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, last = None, 0, 0
        for batch in batches:
            out, g, run, x = [], batch[group].to_numpy(), batch["_run"].to_numpy(), batch["_x"].to_numpy()
            cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (run[1:] != run[:-1])) + 1).tolist(), len(x)] if len(x) else [0]
            for i, j in zip(cuts, cuts[1:], strict=False):
                while i < j:
                    if key != (g[i], run[i]) or x[i] - first >= width:
                        out += [(key[0], first, last - first + 1)] if key else []
                        key, first = (g[i], run[i]), x[i]
                    i += int(np.searchsorted(x[i:j], first + width))
                    last = x[i - 1]
            yield pd.DataFrame(out, columns=[group, "start", "length"])
        if key:
            yield pd.DataFrame([(key[0], first, last - first + 1)], columns=[group, "start", "length"])

    kind = offsets.schema[group].dataType.simpleString()
    return runs.repartition(group, "_run").sortWithinPartitions(group, "_run", "_x").mapInPandas(greedy, f"`{group}` {kind}, start long, length long")


def base_offsets(files: DataFrame, order: str, rows: str) -> DataFrame:
    """Adds base: the rows of all earlier files."""
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum(rows).over(w), F.lit(0)))


def slice_filter(conditions: list[Column]) -> Column:
    """All conditions; one that is null does not match."""
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def stale_phrases(lines: DataFrame, text: str, phrases: list[str]) -> DataFrame:
    """Lines (numbered from 1 within the row) that hold a phrase, with the phrase."""
    split = lines.select(*[c for c in lines.columns if c != text], F.posexplode(F.split(text, "\n")).alias("_i", "line"))
    return split.select("*", F.explode(F.array(*map(F.lit, phrases))).alias("phrase")).where(F.contains(F.lower("line"), F.lower("phrase"))).withColumn("line_number", F.col("_i") + 1).drop("_i")


def changed_by_arm(pairs: DataFrame, arm: str) -> DataFrame:
    """n and changes of hands, manipulation, either, between a label and its review (review columns prefixed re_)."""
    h, m = F.col("hands_visible") != F.col("re_hands_visible"), F.col("manipulation") != F.col("re_manipulation")
    return pairs.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.count_if(h).alias("hands_changed"), F.count_if(m).alias("manipulation_changed"), F.count_if(h | m).alias("either_changed"))


def manifest_summary(clips: DataFrame) -> DataFrame:
    return clips.agg(
        F.count(F.lit(1)).alias("clips"), F.count_distinct("shard").alias("shards"), F.count_distinct("factory_id").alias("factories"),
        F.count_distinct(F.struct("factory_id", "worker_id")).alias("workers"), (F.sum("duration_sec") / 3600).alias("hours"),
    )


def worker_hours(clips: DataFrame) -> DataFrame:
    return clips.groupBy("factory_id").agg((F.sum("duration_sec") / 3600).alias("hours"))


def thumbnails(frames: DataFrame, order: str, width: int, height: int) -> DataFrame:
    """A square-ish atlas: each row's tile by its rank."""
    cols = frames.agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_c"))
    return ranked(frames, order, "_r").withColumn("_i", F.col("_r") - 1).crossJoin(F.broadcast(cols)).select(*frames.columns, (F.col("_i") % F.col("_c") * width).alias("x"), (F.floor(F.col("_i") / F.col("_c")) * height).alias("y"))
