"""Record schemas and, for each record, a column that names its violations (empty when valid)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from assayer.functions import vocab

_S, _I, _L, _D, _B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


CONFIDENCE = _struct(kind=_S, value=_D)
FRAME = _struct(
    frame_id=_S, corpus=_S, corpus_rev=_S, sample=_S, stratum=_S, factory_id=_S, worker_id=_S, clip_id=_S, frame_index=_L,
    timestamp_s=_D, width=_I, height=_I, fps=_D, codec=_S, why_no_provenance=_S,
)
RESPONSE = _struct(frame_id=_S, judge=_S, judge_rev=_S, prompt_variant=_S, hands_visible=_I, manipulation=_B, confidence=CONFIDENCE, raw=_S, status=_S, latency_ms=_L, cost_usd=_D)
LABEL = StructType([
    *_struct(frame_id=_S, rater=_S).fields, StructField("pass", _S), *_struct(rubric_rev=_S, hands_visible=_I, manipulation=_B, edge_case=ArrayType(_S), difficulty=_S, note=_S, labelled_at=TimestampType(), seconds_spent=_I).fields,
])
MANIFEST = _struct(shard=_S, clip_id=_S, factory_id=_S, worker_id=_S, codec=_S, video_index=_I, width=_I, height=_I, duration_sec=_D, fps=_D, mp4_offset=_L, mp4_size=_L)

#: The frame fields that are null together.
PROVENANCE = ("factory_id", "worker_id", "clip_id", "timestamp_s", "fps", "codec")


def named(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that are broken; a rule that is null counts as kept."""
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())


def frame_violations(known: Column | None = None) -> Column:
    nulls = sum((F.col(c).isNull().cast("int") for c in PROVENANCE), F.lit(0))
    reason = F.length(F.trim(F.coalesce("why_no_provenance", F.lit("")))) > 0
    return named(("some provenance missing", nulls.between(1, len(PROVENANCE) - 1)), ("no reason for missing provenance", (nulls == len(PROVENANCE)) & ~reason), ("reason with provenance", (nulls == 0) & reason))


def confidence_violations(kind: Column, value: Column) -> Column:
    return named(
        ("unknown confidence kind", ~kind.isin(*vocab.CONFIDENCE_KINDS)),
        ("value without kind", (kind == "none") & value.isNotNull()),
        ("kind without value", (kind != "none") & value.isNull()),
        ("value outside [0, 1]", ~value.between(0, 1)),
    )


def response_violations() -> Column:
    ok = F.col("status") == "ok"
    both, either = F.col("hands_visible").isNotNull() & F.col("manipulation").isNotNull(), F.col("hands_visible").isNotNull() | F.col("manipulation").isNotNull()
    return F.concat(
        named(
            ("unknown status", ~F.col("status").isin(*vocab.STATUSES)),
            ("unknown prompt variant", ~F.col("prompt_variant").isin(*vocab.VARIANTS)),
            ("hands outside 0 to 2", ~F.col("hands_visible").between(0, 2)),
            ("ok without answers", ok & ~both),
            ("answers without ok", ~ok & either),
        ),
        confidence_violations(F.col("confidence.kind"), F.col("confidence.value")),
    )


def label_violations(tags: tuple[str, ...]) -> Column:
    return named(
        ("unknown pass", ~F.col("pass").isin(*vocab.PASSES)),
        ("unknown difficulty", ~F.col("difficulty").isin(*vocab.DIFFICULTIES)),
        ("hands outside 0 to 2", ~F.col("hands_visible").between(0, 2)),
        ("answer missing", F.col("hands_visible").isNull() | F.col("manipulation").isNull()),
        ("unknown tag", F.size(F.array_except("edge_case", F.array(*map(F.lit, tags)))) > 0),
    )


def zero_hands_rule_broken() -> Column:
    """No hands, yet manipulation: reported, never rejected."""
    return (F.col("hands_visible") == 0) & F.col("manipulation")


def interval_violations() -> Column:
    clustered = F.col("method") == "cluster-bootstrap"
    return named(
        ("unknown method", ~F.col("method").isin("iid", "cluster-bootstrap")),
        ("cluster bootstrap without clusters or B", clustered & (F.col("clusters").isNull() | F.col("B").isNull())),
        ("iid with clusters or B", ~clustered & (F.col("clusters").isNotNull() | F.col("B").isNotNull())),
    )


def prevalence_violations() -> Column:
    named_by, reason = F.col("cluster_by").isNotNull(), F.col("why_not_clustered").isNotNull()
    return named(("clustered without cluster_by", F.col("clustered") & ~named_by), ("clustered with a reason against", F.col("clustered") & reason), ("unclustered without a reason", ~F.col("clustered") & ~reason), ("unclustered with cluster_by", ~F.col("clustered") & named_by))
