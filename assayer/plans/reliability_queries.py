"""Queries for retest agreement, assembled results, task outcomes, judge quality and clustered prevalence."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import agreement as A
from assayer.operators import reliability as L
from assayer.operators.pairing import timed_retest
from assayer.plans.agreement_queries import _TUNED
from assayer.plans.standins import all_pairs, frames, gold, ok_pairs, responses, sql
from assayer.plans.stat_queries import _B, _cluster, _recursive
from assayer.sources.shared import stored

Q, SQL = {}, {}
R = lambda c, n=6: F.round(F.col(c), n).alias(c)


def query(name: str, oracle: str):
    def add(f):
        Q[name], SQL[name] = f, oracle
        return f

    return add


def _passes(spark, d):
    """Labels as a first pass, and a second pass over every third frame that changes some answers; some come before the first."""
    g = gold(spark, d)
    first = g.withColumn("at", F.col("frame_id") * 10)
    second = g.where("frame_id % 3 = 0").select("frame_id", F.when(F.col("frame_id") % 7 == 0, (F.col("gold_hands") + 1) % 3).otherwise(F.col("gold_hands")).alias("gold_hands"), (F.col("gold_manip") != (F.col("frame_id") % 5 == 0)).alias("gold_manip"), (F.col("frame_id") * 10 + F.col("frame_id") % 4 - 1).alias("at"))
    return first, second


_RETESTS = """
first AS (SELECT *, frame_id * 10 AS at1 FROM gold),
second AS (SELECT frame_id, CASE WHEN frame_id % 7 = 0 THEN (gold_hands + 1) % 3 ELSE gold_hands END AS h2, gold_manip <> (frame_id % 5 = 0) AS m2, frame_id * 10 + frame_id % 4 - 1 AS at2 FROM gold WHERE frame_id % 3 = 0),
paired AS (SELECT * FROM first JOIN second USING (frame_id)),
c AS (SELECT avg((gold_manip = m2)::INT) AS raw, avg(gold_manip::INT) AS pa, avg(m2::INT) AS pb, count(*) AS n FROM paired {where})
"""


@query("intra_rater_kappa", sql("WITH " + _RETESTS.format(where="") + "SELECT n, round(raw, 6) AS raw, round((raw - pa*pb - (1-pa)*(1-pb)) / (1 - pa*pb - (1-pa)*(1-pb)), 6) AS kappa FROM c"))
def intra_rater_kappa(spark, d):
    return A.agreement(L.retest_pairs(*_passes(spark, d), "at"), "gold_manip", "re_gold_manip", (False, True)).select("n", R("raw"), R("kappa"))


@query("intra_rater_ac1", sql("WITH " + _RETESTS.format(where="WHERE at2 >= at1") + "SELECT n, round((raw - (pa+pb)*(1-(pa+pb)/2)) / (1 - (pa+pb)*(1-(pa+pb)/2)), 6) AS ac1 FROM c"))
def intra_rater_ac1(spark, d):
    return A.agreement(timed_retest(*_passes(spark, d), at="at"), "gold_manip", "re_gold_manip", (False, True)).select("n", R("ac1"))


@query("task_outcomes", sql("""SELECT task, count(*) AS n, sum(value)::BIGINT AS positive FROM (
  SELECT 'hands_ge_1' AS task, (hands >= 1)::INT AS value FROM responses WHERE status = 'ok' UNION ALL SELECT 'hands_eq_2', (hands = 2)::INT FROM responses WHERE status = 'ok'
  UNION ALL SELECT 'manipulation', manip::INT FROM responses WHERE status = 'ok') WHERE value IS NOT NULL GROUP BY 1"""))
def task_outcomes(spark, d):
    return L.task_outcomes(responses(spark, d), "frame_id", "judge").groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("positive"))


@query("assembled_agreement", sql("""WITH a AS (SELECT judge, count(*) AS n, avg((manip = gold_manip)::INT) AS raw, avg(manip::INT) AS pa, avg(gold_manip::INT) AS pb FROM ok_pairs GROUP BY 1),
x AS (SELECT judge, count(*) AS n_excluded, string_agg(status || '=' || k, ',' ORDER BY status) AS excluded_why FROM (SELECT judge, status, count(*) AS k FROM pairs WHERE status <> 'ok' GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT judge, sum((status <> 'ok')::INT)::BIGINT AS n_excluded FROM pairs GROUP BY 1)
SELECT judge, n, coalesce(t.n_excluded, 0) AS n_excluded, coalesce(excluded_why, '') AS excluded_why, round(raw, 6) AS raw, round((raw - (pa+pb)*(1-(pa+pb)/2)) / (1 - (pa+pb)*(1-(pa+pb)/2)), 6) AS ac1,
  round((raw - pa*pb - (1-pa)*(1-pb)) / (1 - pa*pb - (1-pa)*(1-pb)), 6) AS kappa FROM a LEFT JOIN x USING (judge) LEFT JOIN t USING (judge)"""))
def assembled_agreement(spark, d):
    out = L.assembled(all_pairs(spark, d), "manip", "gold_manip", (False, True), "judge")
    why = F.array_join(F.transform(F.array_sort(F.map_entries("excluded_why")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("judge", "n", "n_excluded", why.alias("excluded_why"), R("raw"), R("ac1"), R("kappa"))


@query("direction_of_agreement", sql("""WITH m AS (SELECT judge, avg((manip = gold_manip)::INT) AS raw, (avg(manip::INT) + avg(gold_manip::INT)) / 2 AS p, avg((hands = gold_hands)::INT) AS hraw,
  (avg((hands=0)::INT) + avg((gold_hands=0)::INT)) / 2 AS p0, (avg((hands=1)::INT) + avg((gold_hands=1)::INT)) / 2 AS p1, (avg((hands=2)::INT) + avg((gold_hands=2)::INT)) / 2 AS p2 FROM ok_pairs GROUP BY 1),
s AS (SELECT judge, (raw - 2*p*(1-p)) / (1 - 2*p*(1-p)) AS a, (hraw - (p0*(1-p0) + p1*(1-p1) + p2*(1-p2)) / 2) / (1 - (p0*(1-p0) + p1*(1-p1) + p2*(1-p2)) / 2) AS h FROM m)
SELECT judge, round(h, 6) AS hands_ac1, round(a, 6) AS manip_ac1, h > a AS holds FROM s"""))
def direction_of_agreement(spark, d):
    p = ok_pairs(spark, d)
    both = L.direction_holds(A.agreement(p, "hands", "gold_hands", (0, 1, 2), "judge"), A.agreement(p, "manip", "gold_manip", (False, True), "judge"), "judge")
    return both.select("judge", R("hands_ac1"), R("manip_ac1"), "holds")


@query("judge_quality_gap", sql("WITH j AS (SELECT judge, corpus, avg((manip = gold_manip)::INT) AS j FROM ok_pairs GROUP BY 1, 2) SELECT judge, round(max(j) - min(j), 6) AS delta_j FROM j GROUP BY 1"))
def judge_quality_gap(spark, d):
    graded = ok_pairs(spark, d).withColumn("correct", F.col("manip") == F.col("gold_manip"))
    return L.quality_gap(L.judge_quality(graded, "correct", "judge", "corpus"), "judge").select("judge", R("delta_j"))


@query("judge_quality", sql("SELECT judge, corpus, round(avg((manip = gold_manip)::INT), 6) AS j FROM ok_pairs GROUP BY 1, 2"))
def judge_quality(spark, d):
    graded = ok_pairs(spark, d).withColumn("correct", F.col("manip") == F.col("gold_manip"))
    return L.judge_quality(graded, "correct", "judge", "corpus").select("judge", "corpus", R("j"))


@query("participant_disparity", "WITH c AS (SELECT lang, count(DISTINCT source) AS n FROM documents GROUP BY 1) SELECT count(*) AS n_groups, round(max(n) / min(n), 6) AS ratio FROM c")
def participant_disparity(spark, d):
    counts = frames(spark, d).groupBy("corpus").agg(F.count_distinct("cluster").alias("n"))
    return L.disparity(counts, "n").select("n_groups", R("ratio"))


_RESIDUALS = _cluster("ppi", "sum(r)", "count(r)", "res")
_ARM = """
gm AS (SELECT count(*) AS n, avg(gold_manip::INT) ym, avg(manip::INT) fm, coalesce(var_samp(manip::INT), 0) fv, coalesce(covar_samp(manip::INT, gold_manip::INT), 0) cv FROM ok_pairs WHERE judge = 'A'),
um AS (SELECT count(*) AS n_unlabelled, avg(manip::INT) um, coalesce(var_samp(manip::INT), 0) uv FROM responses WHERE status = 'ok' AND judge = 'A' AND frame_id NOT IN (SELECT frame_id FROM gold)),
pt AS (SELECT *, """ + _TUNED + """ AS lam FROM gm, um),
res AS (SELECT cluster, gold_manip::INT - (SELECT lam FROM pt) * manip::INT AS r FROM ok_pairs WHERE judge = 'A'),
"""


@query("prevalence_ppi_clustered", _recursive(sql("WITH " + _ARM + _RESIDUALS + """, se AS (SELECT *, lam * um + ym - lam * fm AS value, sqrt(pow((hi - lo) / (2 * 1.959963984540054), 2) + lam * lam * uv / n_unlabelled) AS se FROM pt, ci)
SELECT n, n_unlabelled, round(lam, 6) AS lam, round(value, 6) AS value, round(se, 6) AS se, round(value - 1.959963984540054 * se, 6) AS lo, round(value + 1.959963984540054 * se, 6) AS hi FROM se""")))
def prevalence_ppi_clustered(spark, d):
    r, labels = stored(responses(spark, d).where("status = 'ok' and judge = 'A'"), "answers"), gold(spark, d)
    unlabelled = r.join(labels.select("frame_id"), "frame_id", "left_anti")
    e = L.clustered_ppi(labels.join(r, "frame_id"), unlabelled, "gold_manip", "manip", "cluster", "ppi", _B)
    return e.select("n", "n_unlabelled", *[R(c) for c in ("lam", "value", "se", "lo", "hi")])
