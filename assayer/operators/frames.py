"""Operators on frames: pools, next frame, wide rows, arms, slices, checks of counts and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalars import draw
from assayer.operators.sampling import uniform

# Marks of records that no judge has answered.
NO_REVISION, FAILED_REVISION, MESSAGE_CHARS = "unknown", "extraction-failed", 2_000


def frame_per_clip(clips: DataFrame, name: str, clip: str, n_frames: str) -> DataFrame:
    """Adds frame_index, one hashed frame of each clip; clips shorter than a frame are left out."""
    return clips.where(F.col(n_frames) >= 1).withColumn("frame_index", draw(name, F.col(n_frames), F.col(clip)))


def next_frame(pool: DataFrame, done: DataFrame, name: str, key: str = "frame_id") -> DataFrame:
    """The first frame of the pool, in the named order, that is not done; no row when all are."""
    return uniform(pool.join(done.select(key), key, "left_anti"), name, 1, key)


def training_labels(train: DataFrame, holdout: DataFrame, labels: DataFrame, key: str = "frame_id") -> DataFrame:
    """Labels of the training frames without those held out."""
    return labels.join(train.join(holdout.select(key), key, "left_anti").select(key), key, "left_semi")


def unknown_ids(named: DataFrame, known: DataFrame, key: str = "frame_id") -> DataFrame:
    """Distinct ids that are named but not known; must be empty where names are checked."""
    return named.select(key).distinct().join(known.select(key), key, "left_anti")


def _unanswered(status: str, judge: Column, revision: str, variant: str) -> list[Column]:
    return [
        judge.alias("judge"), F.lit(revision).alias("judge_rev"), F.lit(variant).alias("prompt_variant"), F.struct(F.lit("none").alias("kind"), F.lit(None).cast("double").alias("value")).alias("confidence"),
        F.lit(status).alias("status"), F.lit(0).cast("long").alias("latency_ms"), F.lit(0.0).alias("cost_usd"),
    ]


def vendor_response(labels: DataFrame, judge: str, hands: str, manipulation: str) -> DataFrame:
    """Stored labels in the shape of responses, the columns that a label lacks constant."""
    raw = F.concat(F.col(hands).cast("string"), F.lit("\n---\n"), F.when(F.col(manipulation), "yes").otherwise("no"))
    return labels.select("frame_id", F.col(hands).cast("int").alias("hands_visible"), F.col(manipulation).alias("manipulation"), raw.alias("raw"), *_unanswered("ok", F.lit(judge), NO_REVISION, "P0b"))


def extraction_failures(frames: DataFrame, judge: str, error: Column, message: Column) -> DataFrame:
    """Frames that could not be decoded as error records with the cause, cut at MESSAGE_CHARS characters."""
    raw = F.substring(F.concat(error, F.lit(": "), message), 1, MESSAGE_CHARS)
    return frames.select("frame_id", F.lit(None).cast("int").alias("hands_visible"), F.lit(None).cast("boolean").alias("manipulation"), raw.alias("raw"), *_unanswered("error", F.lit(judge), FAILED_REVISION, "P0a"))


def vendor_arm(gold_answers: DataFrame, labels: DataFrame, arm: DataFrame, judge: str, hands: str, manipulation: str) -> DataFrame:
    """The vendor's answers for gold frames and, of the other frames of the arm, its stored labels."""
    rest = vendor_response(labels.join(arm.select("frame_id"), "frame_id", "left_semi").join(gold_answers.select("frame_id"), "frame_id", "left_anti"), judge, hands, manipulation)
    return gold_answers.unionByName(rest.select(*gold_answers.columns))


def wide_frames(frames: DataFrame, judge: DataFrame, order: list[str], **others: DataFrame) -> DataFrame:
    """Frames that the judge has seen, its answer and those of the others (null where one has none) as structs, in order."""
    nested = lambda df, name: df.select("frame_id", F.struct(*[c for c in df.columns if c != "frame_id"]).alias(name))
    out = frames.join(nested(judge, "judge"), "frame_id")
    for name, df in others.items():
        out = out.join(nested(df, name), "frame_id", "left")
    return out.orderBy(*order)


def answer_matches(task: str, wanted: str, hands: Column, manipulation: Column) -> Column:
    """Whether an answer is the wanted one of its task: yes or no for manipulation, 0, 1, 2 for hands; null is no match."""
    found = manipulation == F.lit(wanted == "yes") if task == "manipulation" else hands == F.lit(int(wanted))
    return F.coalesce(found, F.lit(False))


def reason_counts(rows: DataFrame, judge: str, rater: str, *by: str) -> DataFrame:
    """Frames where the judge says yes and the rater no, the reverse, and those without an answer of the judge."""
    j, r = F.col(judge), F.col(rater)
    return rows.groupBy(*by).agg(F.count_if(j & ~r).alias("judge_yes_rater_no"), F.count_if(~j & r).alias("judge_no_rater_yes"), F.count_if(j.isNull()).alias("unparsed"))


def tiers(frames: DataFrame, shipped: DataFrame, withheld: DataFrame, key: str = "frame_id") -> DataFrame:
    """Adds tier: withheld before shipped, else remote."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    both = frames.join(mark(shipped, "_shipped"), key, "left").join(mark(withheld, "_withheld"), key, "left")
    return both.withColumn("tier", F.when(F.col("_withheld"), "withheld").when(F.col("_shipped"), "shipped").otherwise("remote")).drop("_shipped", "_withheld")


def eligible_tiles(labelled: DataFrame, reviewed: DataFrame, withheld: DataFrame, key: str = "frame_id") -> DataFrame:
    """key, state: labelled frames that are not withheld, eligible if reviewed, else awaiting review."""
    seen = reviewed.select(key).distinct().withColumn("_seen", F.lit(True))
    open_ = labelled.select(key).distinct().join(withheld.select(key), key, "left_anti").join(seen, key, "left")
    return open_.select(key, F.when(F.col("_seen"), "eligible").otherwise("awaiting review").alias("state"))


def of_one_kind(rows: DataFrame, kind: str) -> DataFrame:
    """Rows whose confidence is of the kind and has a value: kinds are never pooled."""
    return rows.where((F.col("confidence.kind") == kind) & F.col("confidence.value").isNotNull())


def disagreeing_counts(found: DataFrame, published: DataFrame, on: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Names whose found and published values differ by more than the tolerance, or that one side lacks; empty is a pass."""
    a, b = found.select(*on, F.col(value).alias("found")), published.select(*on, F.col(value).alias("published"))
    both = a.join(b, on, "full")
    return both.where(F.coalesce(F.abs(F.col("found") - F.col("published")) > tolerance, F.lit(True)))


def closed_tags(text: Column, heading: str) -> Column:
    """Tags in backticks in the paragraph below a heading."""
    block = F.regexp_extract(text, rf"(?s)\Q{heading}\E\s*(.*?)(\n\n|\z)", 1)
    return F.array_sort(F.array_distinct(F.regexp_extract_all(block, F.lit("`([a-z-]+)`"), F.lit(1))))


def referenced_tags(text: Column) -> Column:
    """Tags that the text attaches: tag or tagged, then the name in backticks, line breaks between them allowed."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\btag(?:ged)?\s+`([a-z-]+)`"), F.lit(1))))


def figure(document: Column, pointer: str, form: str) -> Column:
    """The number at a dotted pointer of a JSON document as it is printed. Forms: pct, ratio, pp or usd with their
    digits, int_comma, raw_int."""
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in pointer.split("."))
    value = F.get_json_object(document, path).cast("double")
    if form in ("int_comma", "raw_int"):
        return F.format_string("%,d" if form == "int_comma" else "%d", value.cast("long"))
    return F.format_string(f"%.{form[-1]}f", value * 100 if form.startswith("pct") else value)


def stale_figures(pins: DataFrame) -> DataFrame:
    """Pins (text, literal) whose literal their text does not hold."""
    return pins.where(~F.contains("text", "literal"))
