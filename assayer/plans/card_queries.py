"""Queries of the sample graph, gold halves, review sets, results assembled in full, run summaries and verdicts that fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import vocab
from assayer.functions.scalars import latency_cost
from assayer.operators import multinomial as T
from assayer.operators import reliability as L
from assayer.operators import sample_graph as G
from assayer.operators import sensitivity as S
from assayer.operators.pairing import timed_retest
from assayer.operators.report import verdict
from assayer.plans.reliability_queries import _RETESTS, _passes
from assayer.plans.resample_queries import tree
from assayer.plans.standins import all_pairs, frames, gold, ok_pairs, responses, sql
from assayer.sources.shared import shared_folder, stored

Q, SQL = {}, {}
R = lambda c, n=6: F.round(F.col(c), n).alias(c)


def query(name: str, oracle: str):
    def add(f):
        Q[name], SQL[name] = f, oracle
        return f

    return add


_GRAPH = [
    G.Sample("R", 60, parents=("E", "P")), G.Sample("E", 120, "all", "en"), G.Sample("P", 80, parents=("U",)), G.Sample("U", 200, pool="everything"), G.Sample("X", 10, pool="lost"), G.Sample("Y", 5, parents=("U", "X")),
]
_DRAWN = "SELECT {of} FROM {pool} ORDER BY md5('777:{name}:' || {of}), {of} LIMIT {n}"


@query("sample_graph", f"""WITH e AS (SELECT doc_id AS k FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 120), u AS (SELECT doc_id AS k FROM documents ORDER BY md5('777:U:' || doc_id), doc_id LIMIT 200),
p AS ({_DRAWN.format(of='k', pool='u', name='P', n=80)}), both_ AS (SELECT k FROM e UNION SELECT k FROM p), r AS ({_DRAWN.format(of='k', pool='both_', name='R', n=60)})
SELECT 'E' AS sample, k AS frame_id, NULL AS reason FROM e UNION ALL SELECT 'U', k, NULL FROM u UNION ALL SELECT 'P', k, NULL FROM p UNION ALL SELECT 'R', k, NULL FROM r UNION ALL SELECT 'X', NULL, 'pool lost is not there' UNION ALL SELECT 'Y', NULL, 'sample X is not there'""")
def sample_graph(spark, d):
    """Members of four dependent samples, read back from the store, and two that are skipped with their reason."""
    path, all_frames = shared_folder(spark, "graph"), frames(spark, d).select("frame_id", "corpus")
    pools = {"everything": all_frames, "en": all_frames.where("corpus = 'en'")}
    outcomes = G.draw(spark, pools, _GRAPH, path)
    stored = spark.read.parquet(path).select("sample", "frame_id", F.lit(None).cast("string").alias("reason"))
    return stored.unionByName(outcomes.where("outcome = 'skipped'").select("sample", F.lit(None).cast("long").alias("frame_id"), "reason"))


@query("gold_halves", "SELECT doc_id AS frame_id, CASE WHEN row_number() OVER (ORDER BY md5('777:halves:' || doc_id), doc_id) <= count(*) OVER () // 2 THEN 'calibration' ELSE 'evaluation' END AS part FROM labels")
def gold_halves(spark, d):
    return G.gold_halves(gold(spark, d), "halves").select("frame_id", "part")


@query("review_set", sql("""WITH j AS (SELECT frame_id, hands <> gold_hands OR manip <> gold_manip AS differs FROM ok_pairs WHERE judge = 'B'), n AS (SELECT count(*) AS n FROM j WHERE differs),
c AS (SELECT frame_id, row_number() OVER (ORDER BY md5('777:review:' || frame_id), frame_id) AS r FROM j WHERE NOT differs),
a AS (SELECT frame_id, 'disagreement' AS arm FROM j WHERE differs UNION ALL SELECT frame_id, 'control' FROM c, n WHERE r <= n),
p AS (SELECT *, (row_number() OVER (PARTITION BY arm ORDER BY md5('777:review:' || frame_id), frame_id) - 1) / count(*) OVER (PARTITION BY arm) AS p FROM a)
SELECT frame_id, arm, row_number() OVER (ORDER BY p, arm, frame_id) AS position FROM p"""))
def review_set(spark, d):
    judged = ok_pairs(spark, d).where("judge = 'B'").select("frame_id", ((F.col("hands") != F.col("gold_hands")) | (F.col("manip") != F.col("gold_manip"))).alias("differs"))
    return G.review_set(judged, "differs", "review", 1.0).select("frame_id", "arm", "position")


def _interval(name: str, source: str, mean: str) -> str:
    return f"{name} AS (SELECT g, quantile_cont({mean}, 0.025) AS lo, quantile_cont({mean}, 0.975) AS hi FROM {source} GROUP BY g)"


def _ac1(cells: str, name: str) -> str:
    """CTEs `name` (g, lo, hi): interval of AC1 over cells g, o, k, x, y."""
    return f"""{tree(cells, name, 2, vocab.RESAMPLES)},
{name}_s AS (SELECT t.g, b, sum(n * (x = y)::INT) / sum(n) AS raw, sum(n * (x::INT + y::INT)) / (2 * sum(n)) AS p FROM {name}_tree t JOIN {name}_cells c ON c.g = t.g AND c.r = t.node WHERE t.h = 0 GROUP BY ALL),
{name}_m AS (SELECT g, CASE WHEN 2 * p * (1 - p) >= 1 THEN 1 ELSE (raw - 2 * p * (1 - p)) / (1 - 2 * p * (1 - p)) END AS m FROM {name}_s),
{_interval(name, f'{name}_m', 'm')}"""


@query("intra_rater_ac1_interval", sql("WITH " + _RETESTS.format(where="WHERE at2 >= at1") + f""",
q AS (SELECT 0 AS g, gold_manip AS x, m2 AS y, gold_manip::INT * 2 + m2::INT AS o, count(*) AS k FROM paired WHERE at2 >= at1 GROUP BY ALL), {_ac1('q', 'z')}
SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM z""").replace("WITH ", "WITH RECURSIVE ", 1))
def intra_rater_ac1_interval(spark, d):
    """Interval of a rater's agreement with an earlier self, both passes resampled together."""
    return T.ac1_intervals(timed_retest(*_passes(spark, d), at="at"), "gold_manip", "re_gold_manip", (False, True), []).select(R("lo"), R("hi"))


@query("assembled_in_full", sql(f"""WITH s AS (SELECT judge AS g, cluster, (manip = gold_manip)::INT::DOUBLE AS value FROM ok_pairs),
q AS (SELECT judge AS g, manip AS x, gold_manip AS y, manip::INT * 2 + gold_manip::INT AS o, count(*) AS k FROM ok_pairs GROUP BY ALL), {_ac1('q', 'z')},
i AS (SELECT g, value AS o, count(*) AS k FROM s GROUP BY ALL), {tree('i', 'i', 1, vocab.RESAMPLES)},
im AS (SELECT t.g, b, sum(n * o) / sum(n) AS m FROM i_tree t JOIN i_cells c ON c.g = t.g AND c.r = t.node WHERE t.h = 0 GROUP BY ALL), {_interval('e', 'im', 'm')},
j AS (SELECT g, cluster AS o, 1 AS k, sum(value) AS s, count(value) AS c FROM s GROUP BY ALL), {tree('j', 'j', 12, vocab.RESAMPLES)},
jm AS (SELECT t.g, b, sum(n * s) / sum(n * c) AS m FROM j_tree t JOIN j_cells c ON c.g = t.g AND c.r = t.node WHERE t.h = 0 GROUP BY ALL), {_interval('f', 'jm', 'm')},
a AS (SELECT judge AS g, count(*) AS n, count(DISTINCT cluster) AS clusters, avg((manip = gold_manip)::INT) AS raw, avg(manip::INT) AS pa, avg(gold_manip::INT) AS pb FROM ok_pairs GROUP BY 1), x AS (SELECT judge AS g, count(*) AS n_excluded FROM pairs WHERE status <> 'ok' GROUP BY 1)
SELECT g AS judge, n, coalesce(n_excluded, 0) AS n_excluded, clusters, round(raw, 6) AS raw, round((raw - (pa+pb)*(1-(pa+pb)/2)) / (1 - (pa+pb)*(1-(pa+pb)/2)), 6) AS ac1, round(z.lo, 6) AS ac1_lo, round(z.hi, 6) AS ac1_hi,
  round(e.lo, 6) AS iid_lo, round(e.hi, 6) AS iid_hi, round(f.lo, 6) AS cluster_lo, round(f.hi, 6) AS cluster_hi, round(CASE WHEN e.hi > e.lo THEN pow((f.hi - f.lo) / (e.hi - e.lo), 2) END, 6) AS design_effect
FROM a LEFT JOIN x USING (g) JOIN z USING (g) JOIN e USING (g) JOIN f USING (g)""").replace("WITH ", "WITH RECURSIVE ", 1))
def assembled_in_full(spark, d):
    """Agreement of each judge with its exclusions, the interval of AC1, and the design effect of raw agreement."""
    out = L.assembled_in_full(stored(all_pairs(spark, d), "pairs"), "manip", "gold_manip", (False, True), "cluster", "judge", vocab.RESAMPLES)
    return out.select("judge", "n", "n_excluded", "clusters", *[R(c) for c in ("raw", "ac1", "ac1_lo", "ac1_hi", "iid_lo", "iid_hi", "cluster_lo", "cluster_hi", "design_effect")])


@query("run_summary", sql("""WITH r AS (SELECT *, frame_id % 50 + 1 AS ms FROM responses), c AS (SELECT judge, string_agg(status || '=' || k, ',' ORDER BY status) AS status_counts FROM (SELECT judge, status, count(*) AS k FROM responses GROUP BY ALL) GROUP BY 1)
SELECT judge, count(*) AS n, count(*) FILTER (status = 'ok') AS n_ok, round(avg((hands >= 1)::INT), 6) AS at_least_one, round(avg((hands = 2)::INT), 6) AS two_hands, round(avg(manip::INT), 6) AS manipulation, sum(ms)::BIGINT AS latency_ms, round(sum(ms / 1000.0 / 3600.0 * 0.8), 9) AS cost_usd,
  count(gold_manip) FILTER (status = 'ok') AS n_comparable, round(avg((hands = gold_hands)::INT), 6) AS hands_agreement, round(avg((manip = gold_manip)::INT), 6) AS labor_agreement, any_value(status_counts) AS status_counts
FROM r LEFT JOIN gold USING (frame_id) JOIN c USING (judge) GROUP BY judge"""))
def run_summary(spark, d):
    """Headline rates, cost, latency, statuses and agreement with published labels of each judge's run."""
    ms = F.col("frame_id") % 50 + 1
    r = stored(responses(spark, d), "answers").withColumnsRenamed({"hands": "hands_visible", "manip": "manipulation"}).withColumns({"latency_ms": ms, "cost_usd": latency_cost(ms, 0.8)})
    out = S.run_summary(r, gold(spark, d).select("frame_id", F.col("gold_hands").alias("hand_count"), F.col("gold_manip").alias("active_labor")), "judge")
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("status_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("judge", "n", "n_ok", R("at_least_one"), R("two_hands"), R("manipulation"), "latency_ms", R("cost_usd", 9), "n_comparable", R("hands_agreement"), R("labor_agreement"), counts.alias("status_counts"))


@query("card_verdicts", sql("""WITH j AS (SELECT count(DISTINCT judge) AS n, max(judge) AS last FROM responses), b AS (SELECT count(*) > 0 AS toxic FROM labels WHERE toxic = 1)
SELECT 'claimed' AS card, 'VERIFIED' AS verdict, n AS n_estimates FROM j UNION ALL SELECT 'one open', CASE WHEN n > 0 THEN 'NOT VERIFIED' ELSE 'VERIFIED' END, n FROM j
UNION ALL SELECT 'blocked', CASE WHEN toxic THEN 'NOT VERIFIED' ELSE 'VERIFIED' END, n FROM j, b UNION ALL SELECT 'noted', 'VERIFIED', n FROM j"""))
def card_verdicts(spark, d):
    """Verdicts of four cards over the judges' estimates: all claimed, one left open, a blocker among the unchecked, and a plain note."""
    estimates = responses(spark, d).select(F.concat(F.lit("prevalence:"), F.col("judge")).alias("ref")).distinct()
    last = estimates.agg(F.max("ref").alias("ref"))
    toxic = spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").limit(1).select(F.lit("labels").alias("item"), F.lit(" blocker: toxic rows are not reviewed").alias("reason"))
    note = toxic.withColumn("reason", F.lit("one rater only, no BLOCKER: seen"))
    named = lambda name, v: v.select(F.lit(name).alias("card"), "verdict", "n_estimates")
    cards = [named("claimed", verdict(estimates, estimates, toxic.where("false"))), named("one open", verdict(estimates, estimates.join(last, "ref", "left_anti"), toxic.where("false"))), named("blocked", verdict(estimates, estimates, toxic)), named("noted", verdict(estimates, estimates, note))]
    return cards[0].unionByName(cards[1]).unionByName(cards[2]).unionByName(cards[3])
