"""The audit card: claims, verdict, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_blocker(reason: Column) -> Column:
    return F.upper(F.trim(reason)).startswith("BLOCKER:")


def verdict(estimates: DataFrame, claims: DataFrame, unchecked: DataFrame) -> DataFrame:
    """verdict, n_estimates: VERIFIED if every estimate (ref) has a claim (ref) and no unchecked item blocks."""
    unclaimed = estimates.join(claims.select("ref").distinct().withColumn("_claimed", F.lit(1)), "ref", "left")
    e = unclaimed.agg(F.count(F.lit(1)).alias("n_estimates"), F.count_if(F.col("_claimed").isNull()).alias("open"))
    b = unchecked.agg(F.count_if(is_blocker(F.col("reason"))).alias("blockers"))
    return e.join(b, F.lit(True)).select(F.when((F.col("open") == 0) & (F.col("blockers") == 0), "VERIFIED").otherwise("NOT VERIFIED").alias("verdict"), "n_estimates")


def card(claims: DataFrame, unchecked: DataFrame, intervals: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row: arrays of structs, the judge revisions as a map, and the document as JSON with its digest."""
    nest = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    maps = revisions.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("judge", "judge_rev")))).alias("judge_revisions"))
    row = nest(claims, "claims").join(nest(unchecked, "unchecked"), F.lit(True)).join(nest(intervals, "intervals"), F.lit(True)).join(maps, F.lit(True))
    document = F.to_json(F.struct("claims", "unchecked", "intervals", "judge_revisions"))
    return row.withColumn("document", document).withColumn("digest", F.sha2("document", 256))


def exit_code(verdicts: DataFrame) -> int:
    """0 for a verified card: one row reaches the driver."""
    return 0 if verdicts.first()["verdict"] == "VERIFIED" else 1


def forest(published: DataFrame, reproduced: DataFrame, alone: DataFrame, corrected: DataFrame) -> DataFrame:
    """Rows of a forest plot: label, kind, value, lo, hi (null where a source gives no interval)."""
    out = None
    for kind, df in (("published", published), ("reproduced", reproduced), ("judge alone", alone), ("corrected", corrected)):
        lo, hi = (F.col(c) if c in df.columns else F.lit(None).cast("double") for c in ("lo", "hi"))
        rows = df.select("label", F.lit(kind).alias("kind"), F.col("value").cast("double").alias("value"), lo.alias("lo"), hi.alias("hi"))
        out = rows if out is None else out.unionByName(rows)
    return out


def figure_tables(prevalence: DataFrame, margins: DataFrame, vendors: DataFrame) -> DataFrame:
    """The printed tables as one long table: section, row, column, value; a figure that a section does not have has no row.

    prevalence: label, published, judge, corrected, lo, hi; margins: label, published, corrected, lo, hi; vendors: label,
    published, judge."""
    out = None
    for section, df in (("prevalence", prevalence), ("margin", margins), ("vendor", vendors)):
        figures = [c for c in df.columns if c != "label"]
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in figures])
        rows = df.select(F.lit(section).alias("section"), F.col("label").alias("row"), F.inline(cells)).where(F.col("value").isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out
