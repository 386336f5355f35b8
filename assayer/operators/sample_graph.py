"""A graph of named samples: each is drawn from a pool or from samples drawn before it, and kept as membership.

Samples are taken in the order of their dependencies. A sample with parents reads
them back from the stored membership, not from the plan that drew them, so a
rerun or a later run draws from what was published. A sample whose pool or parent
is not there is skipped with its reason, and so is all that depends on it. A
rerun rewrites a sample only if its members changed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import sampling
from assayer.sources.sinks import write_membership

OUTCOMES = "sample string, outcome string, n long, reason string"


@dataclass(frozen=True)
class Sample:
    """A sample of n rows: 'all' and 'uniform' draw from a pool, 'stratified' too (options: stratum, weights, weight, clip), 'parents' from other samples."""

    name: str
    n: int
    kind: str = "uniform"
    pool: str | None = None
    parents: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


def order(samples: list[Sample]) -> list[Sample]:
    """The samples so that parents come first, otherwise as given; a cycle, an unknown parent or a name twice raises."""
    by_name = {s.name: s for s in samples}
    if len(by_name) < len(samples):
        raise ValueError("a sample is named twice")
    done: dict[str, bool] = {}
    out: list[Sample] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name not in by_name:
            raise ValueError(f"{path[-1]} has an unknown parent: {name}")
        if name in path:
            raise ValueError(f"samples depend on each other: {' -> '.join([*path, name])}")
        if not done.get(name):
            for parent in by_name[name].parents:
                visit(parent, (*path, name))
            done[name] = True
            out.append(by_name[name])

    for s in samples:
        visit(s.name, ())
    return out


def members(spark: SparkSession, path: str, sample: str) -> DataFrame | None:
    """A sample's stored members; None if it has none. A member without an id, or twice in the sample, raises when read."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    rows = rows.where(F.col("sample") == sample).drop("sample")
    return None if rows.isEmpty() else rows


def checked(rows: DataFrame, key: str) -> DataFrame:
    """The rows, once it is certain that each has an id of its own."""
    worst = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col(key).isNull() | (F.col("n") > 1)).alias("bad")).first()["bad"]
    if worst:
        raise ValueError(f"membership holds {worst} ids that are null or twice in a sample")
    return rows


def _digest(rows: DataFrame, key: str) -> tuple:
    return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(key).cast("decimal(20, 0)")), F.bit_xor(F.xxhash64(F.lit(1), key))).first())


def draw(spark: SparkSession, pools: dict[str, DataFrame], samples: list[Sample], path: str, key: str = "frame_id") -> DataFrame:
    """Draw and store every sample that can be drawn; sample, outcome (drawn, unchanged or skipped), n, reason."""
    outcomes: list[tuple] = []
    skipped: set[str] = set()
    for s in order(samples):
        parents = [None if p in skipped else members(spark, path, p) for p in s.parents]
        lacking = [p for p, rows in zip(s.parents, parents, strict=True) if rows is None]
        if lacking or (not s.parents and s.pool not in pools):
            skipped.add(s.name)
            outcomes.append((s.name, "skipped", None, f"sample {lacking[0]} is not there" if lacking else f"pool {s.pool} is not there"))
            continue
        if s.parents:
            pool = checked(parents[0], key).select(key)
            for p in parents[1:]:
                pool = pool.unionByName(checked(p, key).select(key))
            drawn = sampling.uniform(pool.distinct(), s.name, s.n, key)
        elif s.kind == "all":
            drawn = sampling.take_all(pools[s.pool], s.n, key)
        elif s.kind == "stratified":
            o = s.options
            drawn = sampling.stratified(pools[s.pool], s.name, s.n, o["stratum"], o["weights"], o["weight"], list(o["clip"]), key)
        else:
            drawn = sampling.uniform(pools[s.pool], s.name, s.n, key)
        drawn = drawn.select(key)
        before = members(spark, path, s.name)
        now = _digest(drawn, key)
        same = before is not None and _digest(before, key) == now
        if not same:
            write_membership(drawn.withColumn("sample", F.lit(s.name)), path)
        outcomes.append((s.name, "unchanged" if same else "drawn", now[0], None))
    return spark.createDataFrame(outcomes, OUTCOMES)


def gold_halves(gold: DataFrame, name: str, key: str = "frame_id") -> DataFrame:
    """gold with part: calibration for the first half by hash (the smaller one of an odd number), evaluation for the rest."""
    half = gold.count() // 2
    ranked = sampling.running(gold, sampling.hash_bucket(name, F.col(key)), [sampling.hash_order(name, F.col(key)), F.col(key)], F.lit(1), "_place")
    return ranked.withColumn("part", F.when(F.col("_place") <= half, "calibration").otherwise("evaluation")).drop("_place")


def review_set(judged: DataFrame, differs: str, name: str, per_disagreement: float, key: str = "frame_id") -> DataFrame:
    """All rows that differ and, for each of them, per_disagreement rows that do not, drawn by hash and as far as there are any; key, arm, position: the arms interleaved evenly."""
    n = judged.where(differs).count()
    controls = sampling.uniform(judged.where(f"NOT {differs}").select(key), name, round(n * per_disagreement), key).withColumn("arm", F.lit("control"))
    return sampling.interleave(judged.where(differs).select(key, F.lit("disagreement").alias("arm")).unionByName(controls), "arm", name, key)
