"""Queries for sampling, resampling, calibration, windows, scalar functions, comparisons and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import scalars as X
from assayer.functions import schemas, vocab
from assayer.operators import agreement as A
from assayer.operators import calibration as C
from assayer.operators import compare as M
from assayer.operators import pairing as P
from assayer.operators import resample as B
from assayer.operators import sampling as S
from assayer.operators.multinomial import seed_of
from assayer.plans.resample_queries import LOW, tree
from assayer.plans.standins import EVENTS, events, frames, gold, ok_pairs, responses, sql, table

Q, SQL = {}, {}
R = lambda c, n=6: F.round(F.col(c), n).alias(c)


def query(name: str, oracle: str | None):
    def add(f):
        Q[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _ids(spark, d):
    return frames(spark, d).select("frame_id", "corpus", "cluster")


_ORDER = "md5('777:{name}:' || doc_id)"


@query("sample_uniform", f"SELECT doc_id AS frame_id FROM documents ORDER BY {_ORDER.format(name='S10k-U')}, doc_id LIMIT 100")
def sample_uniform(spark, d):
    return S.uniform(_ids(spark, d).select("frame_id"), "S10k-U", 100)


@query("sample_all", "SELECT doc_id AS frame_id FROM documents ORDER BY doc_id LIMIT 300")
def sample_all(spark, d):
    return S.take_all(_ids(spark, d).select("frame_id"), 300)


@query("sample_from_parents", "SELECT doc_id AS frame_id FROM documents WHERE lang IN ('en', 'fr') ORDER BY md5('777:R100:' || doc_id), doc_id LIMIT 100")
def sample_from_parents(spark, d):
    p = _ids(spark, d)
    return S.from_parents([p.where(f"corpus = '{c}'").select("frame_id") for c in ("en", "fr")], "R100", 100)


@query("one_per_cluster", "SELECT cluster, frame_id FROM (SELECT source AS cluster, doc_id AS frame_id, row_number() OVER (PARTITION BY source ORDER BY md5('777:clip:' || doc_id), doc_id) AS r FROM documents) WHERE r = 1")
def one_per_cluster(spark, d):
    return S.one_per(_ids(spark, d), "clip", ["cluster"]).select("cluster", "frame_id")


_APPORTION = """
w AS (SELECT n_name AS stratum, sum(s_acctbal) AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY 1),
s AS (SELECT stratum, weight, weight * 500 / sum(weight) OVER () AS share FROM w),
f AS (SELECT *, floor(share)::BIGINT AS fl FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY share - fl DESC, stratum) AS r, 500 - sum(fl) OVER () AS left_ FROM f)
"""


@query("apportion_by_weight", "WITH " + _APPORTION + "SELECT stratum, fl + (r <= left_)::INT AS alloc FROM r")
def apportion_by_weight(spark, d):
    w = table(spark, d, "supplier").where("s_acctbal > 0").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("stratum")).agg(F.sum("s_acctbal").alias("weight"))
    return S.apportion(w, "stratum", "weight", 500).select("stratum", "alloc")


@query("sample_stratified", """WITH w AS (SELECT lang AS corpus, count(*)::DOUBLE AS weight FROM documents GROUP BY 1), s AS (SELECT *, weight*40/sum(weight) OVER () AS share FROM w), f AS (SELECT *, floor(share)::BIGINT AS fl FROM s),
a AS (SELECT corpus, fl + (row_number() OVER (ORDER BY share - fl DESC, corpus) <= 40 - sum(fl) OVER ())::INT AS alloc FROM f),
one AS (SELECT lang AS corpus, source AS cluster, doc_id AS frame_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5('777:S10k-S:' || doc_id), doc_id) AS r FROM documents),
k AS (SELECT corpus, frame_id, row_number() OVER (PARTITION BY corpus ORDER BY md5('777:S10k-S:' || frame_id), frame_id) AS k FROM one WHERE r = 1)
SELECT corpus, frame_id FROM k JOIN a USING (corpus) WHERE k <= alloc""")
def sample_stratified(spark, d):
    p = _ids(spark, d)
    w = p.groupBy("corpus").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return S.stratified(p, "S10k-S", 40, "corpus", w, "weight", ["corpus", "cluster"]).select("corpus", "frame_id")


_DRAW = "(('0x' || substr(md5(concat_ws(':', '777', '{name}', {parts})), 1, 12))::BIGINT) % {mod}"


@query("sample_by_weight", f"""WITH w AS (SELECT p_partkey AS item, p_size::BIGINT AS w, substr(md5('777:pool:' || p_partkey), 1, 3) AS b FROM part),
c AS (SELECT item, w, sum(w) OVER (ORDER BY b, item) AS hi, sum(w) OVER () AS total FROM w),
p AS (SELECT i, {_DRAW.format(name='pool', parts='i', mod='(SELECT max(total) FROM c)')} AS u FROM range(500) t(i))
SELECT item, (u - (hi - w))::BIGINT AS "offset", min(i) AS draw FROM p JOIN c ON u >= hi - w AND u < hi GROUP BY 1, 2""")
def sample_by_weight(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").cast("long").alias("w"))
    return S.by_weight(items, "pool", 500, "w", "item")


@query("split_train_holdout", "SELECT frame_id, CASE WHEN r <= 300 THEN 'train' ELSE 'holdout' END AS part FROM (SELECT doc_id AS frame_id, row_number() OVER (ORDER BY md5('777:rung1:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 400")
def split_train_holdout(spark, d):
    return S.split(_ids(spark, d).select("frame_id"), "rung1", {"train": 300, "holdout": 100})


@query("interleave_arms", """WITH p AS (SELECT doc_id AS frame_id, lang AS corpus, (row_number() OVER (PARTITION BY lang ORDER BY md5('777:review:' || doc_id), doc_id) - 1) / count(*) OVER (PARTITION BY lang) AS p FROM documents)
SELECT frame_id, corpus, row_number() OVER (ORDER BY p, corpus, frame_id) AS position FROM p""")
def interleave_arms(spark, d):
    return S.interleave(_ids(spark, d).select("frame_id", "corpus"), "corpus", "review")


@query("replace_undecodable", """WITH m AS (SELECT doc_id AS frame_id, row_number() OVER (ORDER BY doc_id) AS position FROM documents WHERE lang = 'en'), r AS (SELECT doc_id AS spare, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE lang <> 'en'),
b AS (SELECT *, row_number() OVER (ORDER BY position) AS k FROM m WHERE frame_id % 17 = 0)
SELECT frame_id, position FROM m WHERE frame_id % 17 <> 0 UNION ALL SELECT spare, position FROM b JOIN r USING (k)""")
def replace_undecodable(spark, d):
    place = lambda where: S.ranked(_ids(spark, d).where(where).select("frame_id"), "frame_id", "position")
    return S.replace_undecodable(place("corpus = 'en'"), place("corpus <> 'en'"), F.col("frame_id") % 17 == 0)


_B = vocab.RESAMPLES
_ANSWERS = "responses WHERE status='ok' AND judge='A'"


def _cluster(name: str, total: str = "sum(manip::INT)::DOUBLE", n: str = "count(manip)", source: str = _ANSWERS) -> str:
    return f"""cc AS (SELECT 0 AS g, cluster AS o, 1 AS k, {total} AS s, {n} AS c FROM {source} GROUP BY cluster),
{tree('cc', 'cc', LOW, _B, seed_of(name))},
cm AS (SELECT b, sum(n * s) / sum(n * c) AS m FROM cc_tree t JOIN cc_cells c ON c.r = t.node WHERE t.h = 0 GROUP BY b),
ci AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM cm)"""


_IID = f"""vc AS (SELECT 0 AS g, manip::INT::DOUBLE AS o, count(*) AS k FROM {_ANSWERS} AND manip IS NOT NULL GROUP BY ALL),
{tree('vc', 'vc', 1, _B, seed_of('iid'))},
im AS (SELECT b, sum(n * o) / sum(n) AS m FROM vc_tree t JOIN vc_cells c ON c.r = t.node WHERE t.h = 0 GROUP BY b),
ii AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM im)"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def _outcome(spark, d):
    return responses(spark, d).where("status = 'ok' and judge = 'A'")


@query("cluster_bootstrap", _recursive(sql("WITH " + _cluster("h2") + " SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM ci")))
def cluster_bootstrap(spark, d):
    return B.cluster_interval(_outcome(spark, d), "manip", "cluster", "h2", _B).select(R("lo"), R("hi"))


@query("iid_bootstrap", _recursive(sql("WITH " + _IID + " SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM ii")))
def iid_bootstrap(spark, d):
    return B.iid_interval(_outcome(spark, d), "manip", "iid", _B).select(R("lo"), R("hi"))


@query("design_effect", _recursive(sql("WITH " + _cluster("h2") + ", " + _IID + " SELECT round(ci.lo,6) AS c_lo, round(ci.hi,6) AS c_hi, round(ii.lo,6) AS i_lo, round(ii.hi,6) AS i_hi, round(pow((ci.hi-ci.lo)/(ii.hi-ii.lo), 2), 6) AS design_effect FROM ci, ii")))
def design_effect(spark, d):
    o = _outcome(spark, d)
    e = B.design_effect(B.cluster_interval(o, "manip", "cluster", "h2", _B), B.iid_interval(o, "manip", "iid", _B))
    return e.select(*[R(c) for c in ("c_lo", "c_hi", "i_lo", "i_hi", "design_effect")])


@query("ac1_bootstrap", _recursive(sql(f"""WITH pc AS (SELECT 0 AS g, manip AS x, gold_manip AS y, manip::INT * 2 + gold_manip::INT AS o, count(*) AS k FROM ok_pairs WHERE judge='B' GROUP BY ALL),
{tree('pc', 'pc', 2, _B, seed_of('ac1'))},
s AS (SELECT b, sum(n * (x = y)::INT) / sum(n) AS raw, sum(n * (x::INT + y::INT)) / (2 * sum(n)) AS p FROM pc_tree t JOIN pc_cells c ON c.r = t.node WHERE t.h = 0 GROUP BY b),
e AS (SELECT CASE WHEN 2*p*(1-p) >= 1 THEN 1 ELSE (raw - 2*p*(1-p)) / (1 - 2*p*(1-p)) END AS ac1 FROM s)
SELECT round(quantile_cont(ac1, 0.025), 6) AS lo, round(quantile_cont(ac1, 0.975), 6) AS hi FROM e""")))
def ac1_bootstrap(spark, d):
    return B.ac1_interval(ok_pairs(spark, d).where("judge = 'B'"), "manip", "gold_manip", (False, True), "ac1", _B).select(R("lo"), R("hi"))


@query("cluster_sizes", sql("SELECT count(*) AS clusters, sum(n)::BIGINT AS observations, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM (SELECT cluster, count(*) AS n FROM responses WHERE status='ok' AND judge='A' GROUP BY 1)"))
def cluster_sizes(spark, d):
    return B.cluster_sizes(_outcome(spark, d), "cluster").withColumn("mean", F.round("mean", 6))


_BINS = "b AS (SELECT judge, least(trunc(conf / 0.1)::INT, 9) AS bin, count(*) AS n, avg(conf) AS mean_conf, avg((manip = gold_manip)::INT) AS accuracy FROM ok_pairs GROUP BY 1, 2)"


def _graded(spark, d):
    return ok_pairs(spark, d).withColumn("correct", F.col("manip") == F.col("gold_manip"))


@query("reliability_bins", sql(f"WITH {_BINS} SELECT judge, i::INT AS bin, i / 10.0::DOUBLE AS lo, (i + 1) / 10.0::DOUBLE AS hi, coalesce(n, 0) AS n, round(mean_conf, 6) AS mean_conf, round(accuracy, 6) AS accuracy FROM (SELECT DISTINCT judge FROM ok_pairs) CROSS JOIN range(10) t(i) LEFT JOIN b USING (judge) WHERE b.bin = i UNION ALL SELECT judge, i::INT, i / 10.0::DOUBLE, (i + 1) / 10.0::DOUBLE, 0, NULL, NULL FROM (SELECT DISTINCT judge FROM ok_pairs) j CROSS JOIN range(10) t(i) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.judge = j.judge AND b.bin = i)"))
def reliability_bins(spark, d):
    return C.reliability_bins(_graded(spark, d), "conf", "correct", "judge").select("judge", "bin", "lo", "hi", "n", R("mean_conf"), R("accuracy"))


@query("calibration_error", sql(f"WITH {_BINS} SELECT judge, sum(n)::BIGINT AS n, round(sum(n * abs(accuracy - mean_conf)) / sum(n), 6) AS ece FROM b GROUP BY 1"))
def calibration_error(spark, d):
    return C.ece(C.reliability_bins(_graded(spark, d), "conf", "correct", "judge"), "judge").select("judge", "n", R("ece"))


_THRESHOLD = """
g AS (SELECT conf AS c, (manip = gold_manip)::INT AS y, frame_id FROM ok_pairs WHERE judge='A'),
r AS (SELECT c, count(*) OVER w AS n, sum(y) OVER w AS k FROM g WINDOW w AS (ORDER BY c DESC, frame_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT c, n, k / n AS p, 1.6448536269514722::DOUBLE AS z FROM r),
t AS (SELECT min(c) AS threshold, max(n) AS answered FROM p WHERE (p + z*z/(2*n) - z*sqrt((p*(1-p) + z*z/(4*n))/n)) / (1 + z*z/n) >= 0.7)
"""


@query("abstention_threshold", sql("WITH " + _THRESHOLD + "SELECT threshold, answered FROM t"))
def abstention_threshold(spark, d):
    return C.threshold(_graded(spark, d).where("judge = 'A'"), "conf", "correct", "frame_id", 0.7)


@query("cascade_coverage", sql("WITH " + _THRESHOLD + "SELECT count(*) AS n, round(avg((c >= threshold)::INT), 6) AS coverage, round(avg(CASE WHEN c >= threshold THEN y END), 6) AS accuracy FROM g, t"))
def cascade_coverage(spark, d):
    g = _graded(spark, d).where("judge = 'A'")
    return C.coverage_and_floor(g, "conf", "correct", C.threshold(g, "conf", "correct", "frame_id", 0.7)).select("n", R("coverage"), R("accuracy"))


@query("wilson", sql("""WITH k AS (SELECT corpus, judge, count(*) AS n, sum(manip::INT) AS k FROM responses WHERE status='ok' GROUP BY 1,2), p AS (SELECT *, k/n AS p, 1.959964::DOUBLE AS z, 1.6448536269514722::DOUBLE AS y FROM k)
SELECT corpus, judge, n, round((p + y*y/(2*n) - y*sqrt((p*(1-p) + y*y/(4*n))/n)) / (1 + y*y/n), 6) AS lower, round(greatest((p+z*z/(2*n))/(1+z*z/n) - z/(1+z*z/n)*sqrt(p*(1-p)/n + z*z/(4*n*n)), 0), 6) AS lo, round(least((p+z*z/(2*n))/(1+z*z/n) + z/(1+z*z/n)*sqrt(p*(1-p)/n + z*z/(4*n*n)), 1), 6) AS hi FROM p"""))
def wilson(spark, d):
    k = responses(spark, d).where("status = 'ok'").groupBy("corpus", "judge").agg(F.count(F.lit(1)).alias("n"), F.count_if("manip").alias("k"))
    i = X.wilson_interval(F.col("k"), F.col("n"))
    return k.select("corpus", "judge", "n", F.round(X.wilson_lower(F.col("k"), F.col("n")), 6).alias("lower"), F.round(i.lo, 6).alias("lo"), F.round(i.hi, 6).alias("hi"))


@query("first_wins", f"WITH {EVENTS} SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM ev) WHERE r = 1")
def first_wins(spark, d):
    return P.first_wins(events(spark, d), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("last_wins", f"WITH {EVENTS} SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM ev) WHERE r = 1")
def last_wins(spark, d):
    return P.last_wins(events(spark, d), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


_RETEST = """r AS (SELECT user_id, event_type, ts, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
t AS (SELECT a.user_id, a.event_type, a.ts AS t1, b.ts AS t2, date_diff('microsecond', a.ts, b.ts) / 86400000000.0::DOUBLE AS days FROM r a JOIN r b USING (user_id, event_type) WHERE a.r = 1 AND b.r = 2 AND b.ts >= a.ts)"""


def _retest(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = events(spark, d).select(F.concat_ws("/", "user_id", "event_type").alias("frame_id"), F.col("ts").alias("labelled_at"), "value", F.row_number().over(w).alias("r"))
    return P.timed_retest(e.where("r = 1").drop("r"), e.where("r = 2").drop("r"))


@query("retest_separation", f"WITH {_RETEST} SELECT count(*) AS n, round(min(days),6) AS least, round(median(days),6) AS median, round(max(days),6) AS most, count(*) FILTER (days >= 7) AS apart, count(*) FILTER (days < 0) AS inverted FROM t")
def retest_separation(spark, d):
    return A.retest_separation(_retest(spark, d)).select("n", R("least"), R("median"), R("most"), "apart", "inverted")


@query("self_agreement", f"WITH {EVENTS}, p AS (SELECT user_id, count(DISTINCT event_type) AS k FROM ev GROUP BY 1) SELECT count(*) AS n, round(avg((k = 1)::INT), 6) AS agreement FROM p")
def self_agreement(spark, d):
    return A.self_agreement(events(spark, d), "event_type", "user_id").select("n", R("agreement"))


@query("run_ledger", f"WITH {EVENTS} SELECT event_type, count(*) AS n, round(sum(value), 2) AS cost, round(median(value), 6) AS p50, round(max(value), 6) AS most FROM ev GROUP BY 1")
def run_ledger(spark, d):
    e = events(spark, d)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("cost"), F.round(F.median("value"), 6).alias("p50"), F.round(F.max("value"), 6).alias("most"))


@query("latency_p95", f"""WITH {EVENTS}, r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM ev),
w AS (SELECT event_type, v, greatest(0, 1 - abs(r - greatest(1, least(n, (n + 1) * 0.95::DOUBLE)))) AS w FROM r) SELECT event_type, round(sum(v * w), 6) AS quantile FROM w WHERE w > 0 GROUP BY 1""")
def latency_p95(spark, d):
    return M.exclusive_quantile(events(spark, d), "value", 0.95, "event_type").select("event_type", R("quantile"))


@query("rater_effort", f"WITH {EVENTS} SELECT user_id % 5 AS rater, count(*) AS n, round(sum(value) / 60, 4) AS minutes, round(median(value), 6) AS median_seconds FROM ev GROUP BY 1")
def rater_effort(spark, d):
    return events(spark, d).groupBy((F.col("user_id") % 5).alias("rater")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value") / 60, 4).alias("minutes"), F.round(F.median("value"), 6).alias("median_seconds"))


@query("multiset_difference", """WITH a AS (SELECT sha256(text) AS h, lang FROM documents), b AS (SELECT sha256(text) AS h, lang FROM documents WHERE doc_id % 10 <> 0), p AS (SELECT h, lang, sum(x) AS x, sum(y) AS y FROM (SELECT h, lang, 1 AS x, 0 AS y FROM a UNION ALL SELECT h, lang, 0, 1 FROM b) GROUP BY 1, 2)
SELECT sum(x)::BIGINT AS n_a, sum(y)::BIGINT AS n_b, sum(greatest(x-y,0))::BIGINT AS only_a, sum(greatest(y-x,0))::BIGINT AS only_b, sum(greatest(x-y,0)) + sum(greatest(y-x,0)) = 0 AS identical FROM p""")
def multiset_difference(spark, d):
    docs = table(spark, d, "documents")
    view = lambda x: x.select(F.sha2("text", 256).alias("h"), "lang")
    return M.multiset_difference(view(docs), view(docs.where("doc_id % 10 <> 0")))


@query("missing_frames", "SELECT l.doc_id AS frame_id, CASE WHEN d.doc_id IS NULL THEN 'absent' ELSE 'empty payload' END AS reason FROM labels l LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS t FROM documents WHERE doc_id % 7 <> 0) d USING (doc_id) WHERE d.doc_id IS NULL OR length(t) = 0")
def missing_frames(spark, d):
    docs = frames(spark, d).where("frame_id % 7 <> 0").withColumn("payload", F.when(F.col("frame_id") % 11 == 0, "").otherwise(F.col("text")))
    return M.missing_frames(gold(spark, d), docs, "payload")


@query("manifest_summary", "SELECT count(*) AS clips, count(DISTINCT l_shipdate) AS shards, count(DISTINCT l_suppkey) AS factories, count(DISTINCT (l_suppkey, l_partkey)) AS workers, round(sum(l_quantity) / 3600, 6) AS hours FROM lineitem")
def manifest_summary(spark, d):
    return M.manifest_summary(_manifest(spark, d)).withColumn("hours", F.round("hours", 6))


def _manifest(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_shipdate").alias("shard"), F.col("l_suppkey").alias("factory_id"), F.col("l_partkey").alias("worker_id"), F.col("l_quantity").alias("duration_sec"))


@query("worker_hours", "SELECT l_suppkey AS factory_id, round(sum(l_quantity) / 3600, 6) AS hours FROM lineitem GROUP BY 1")
def worker_hours(spark, d):
    return M.worker_hours(_manifest(spark, d)).withColumn("hours", F.round("hours", 6))


@query("base_offsets", "SELECT source, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def base_offsets(spark, d):
    return M.base_offsets(table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "n")


@query("coalesce_spans", """WITH RECURSIVE o AS (SELECT DISTINCT o_custkey AS g, o_orderkey AS x FROM orders), s AS (SELECT g, min(x) AS st FROM o GROUP BY 1 UNION ALL SELECT s.g, (SELECT min(x) FROM o WHERE o.g = s.g AND o.x >= s.st + 500) FROM s WHERE (SELECT min(x) FROM o WHERE o.g = s.g AND o.x >= s.st + 500) IS NOT NULL)
SELECT s.g AS o_custkey, s.st AS start, max(o.x) - s.st + 1 AS length FROM s JOIN o ON o.g = s.g AND o.x >= s.st AND o.x < s.st + 500 GROUP BY 1, 2""")
def coalesce_spans(spark, d):
    return M.coalesce_spans(table(spark, d, "orders"), "o_custkey", "o_orderkey", 500)


@query("stale_phrases", "SELECT doc_id, (i + 1)::INT AS line_number, phrase, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), (VALUES ('licensed under'), ('email')) p(phrase) WHERE contains(lower(line), phrase) GROUP BY ALL")
def stale_phrases(spark, d):
    return M.stale_phrases(table(spark, d, "documents").select("doc_id", "text"), "text", ["licensed under", "email"]).groupBy("doc_id", F.col("line_number").cast("int").alias("line_number"), "phrase").agg(F.count(F.lit(1)).alias("n"))


@query("slice_filter", sql("SELECT frame_id, judge FROM pairs WHERE corpus = 'en' AND manip = gold_manip AND conf >= 0.9"))
def slice_filter(spark, d):
    p = gold(spark, d).join(responses(spark, d), "frame_id")
    keep = M.slice_filter([F.col("corpus") == "en", X.agrees(F.col("manip"), F.col("gold_manip")), X.confidence_band(F.col("conf")).isin("high", "middle")])
    return p.where(keep).select("frame_id", "judge")


@query("confidence_bands", sql("SELECT judge, CASE WHEN conf >= 0.99 THEN 'high' WHEN conf >= 0.9 THEN 'middle' ELSE 'low' END AS band, count(*) AS n, count(*) FILTER (manip = gold_manip) AS agreeing FROM ok_pairs GROUP BY 1, 2"))
def confidence_bands(spark, d):
    return ok_pairs(spark, d).groupBy("judge", X.confidence_band(F.col("conf")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(X.agrees(F.col("manip"), F.col("gold_manip"))).alias("agreeing"))


_RAW = """raw_ AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '2' WHEN 1 THEN ' "1" ' WHEN 2 THEN 'Yes.' WHEN 3 THEN 'no, 0.8' WHEN 4 THEN 'I cannot help with that' WHEN 5 THEN 'two hands' WHEN 6 THEN '0, 1.4' ELSE '3' END AS raw FROM documents),
tok AS (SELECT *, lower(regexp_extract(raw, '^\\s*["''`]?\\s*([0-2]|yes|no)\\s*["''`]?\\s*(?:,\\s*([0-9]*\\.?[0-9]+))?\\s*\\.?\\s*$', 1, 'i')) AS t, try_cast(regexp_extract(raw, '^\\s*["''`]?\\s*([0-2]|yes|no)\\s*["''`]?\\s*(?:,\\s*([0-9]*\\.?[0-9]+))?\\s*\\.?\\s*$', 2, 'i') AS DOUBLE) AS c FROM raw_)""".replace("\\\\", "\\")


@query("parse_answers", f"""WITH {_RAW} SELECT doc_id, CASE WHEN t IN ('0','1','2') THEN t::INT END AS hands, CASE WHEN t IN ('0','1','2') THEN 'ok' WHEN lower(raw) LIKE 'i cannot%' THEN 'refused' ELSE 'unparseable' END AS hands_status,
CASE WHEN t IN ('yes','no') THEN t = 'yes' END AS manip, CASE WHEN t IN ('yes','no') THEN 'ok' WHEN lower(raw) LIKE 'i cannot%' THEN 'refused' ELSE 'unparseable' END AS manip_status, CASE WHEN c BETWEEN 0 AND 1 THEN c END AS conf,
CASE WHEN lower(raw) LIKE 'i cannot%' THEN 'refused' ELSE 'unparseable' END AS combined FROM tok""")
def parse_answers(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("2", ' "1" ', "Yes.", "no, 0.8", "I cannot help with that", "two hands", "0, 1.4", "3"))), (F.col("doc_id") % 8 + 1).cast("int"))
    p = table(spark, d, "documents").select("doc_id", raw.alias("raw")).select("doc_id", X.parse_hand_count(F.col("raw")).alias("h"), X.parse_manipulation(F.col("raw")).alias("m"), X.verbalized_confidence(F.col("raw")).alias("c"))
    return p.select("doc_id", F.col("h.value").alias("hands"), F.col("h.status").alias("hands_status"), F.col("m.value").alias("manip"), F.col("m.status").alias("manip_status"), F.col("c.value").alias("conf"), X.combine_status(F.col("h.status"), F.col("m.status")).alias("combined"))


@query("identifiers", "SELECT doc_id, 'doc-sha256:' || sha256(text) AS content_id, printf('ego10k/%s/%08d', source, doc_id) AS frame_id, lang || '/' || source AS worker, round(n_chars / 1000.0 / 3600.0 * 0.8, 9) AS cost FROM documents")
def identifiers(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_id("doc-sha256:", F.col("text")).alias("content_id"), X.frame_id("ego10k", F.col("source"), F.col("doc_id")).alias("frame_id"), X.qualified_worker(F.col("lang"), F.col("source")).alias("worker"), F.round(X.latency_cost(F.col("n_chars"), 0.8), 9).alias("cost"))


@query("zero_hands_violations", sql("SELECT corpus, judge, count(*) AS n FROM responses WHERE hands = 0 AND manip GROUP BY 1, 2"))
def zero_hands_violations(spark, d):
    r = responses(spark, d).withColumnsRenamed({"hands": "hands_visible", "manip": "manipulation"})
    return r.where(schemas.zero_hands_rule_broken()).groupBy("corpus", "judge").agg(F.count(F.lit(1)).alias("n"))


@query("review_changes", sql("SELECT corpus, count(*) AS n, count(*) FILTER (hands <> gold_hands) AS hands_changed, count(*) FILTER (manip <> gold_manip) AS manipulation_changed, count(*) FILTER (hands <> gold_hands OR manip <> gold_manip) AS either_changed FROM ok_pairs WHERE judge='B' GROUP BY 1"))
def review_changes(spark, d):
    p = ok_pairs(spark, d).where("judge = 'B'").withColumnsRenamed({"hands": "re_hands_visible", "manip": "re_manipulation", "gold_hands": "hands_visible", "gold_manip": "manipulation"})
    return M.changed_by_arm(p, "corpus")


@query("thumbnail_atlas", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, ceil(sqrt(count(*) OVER ()))::BIGINT AS c FROM documents) SELECT doc_id, (i % c * 160)::BIGINT AS x, (i // c * 90)::BIGINT AS y FROM r")
def thumbnail_atlas(spark, d):
    return M.thumbnails(table(spark, d, "documents").select("doc_id"), "doc_id", 160, 90)


@query("power_of_two_proportions", None)
def power_of_two_proportions(spark, d):
    from assayer.operators.simulate import two_proportion_power

    return two_proportion_power(spark, [0.05, 0.1, 0.2, 0.3], 200, 0.05, 20_000)


@query("tar_manifest", "SELECT * FROM (VALUES ('shard0.tar', 'clip00', 512, 700, 2048), ('shard0.tar', 'clip01', 3072, 1400, 5120), ('shard0.tar', 'clip02', 6144, 2100, 9216), ('shard1.tar', 'clip10', 512, 700, 2048), ('shard1.tar', 'clip11', 3072, 1400, 5120)) t(shard, stem, mp4_offset, mp4_size, json_offset)")
def tar_manifest(spark, d):
    from assayer.sources.tar import demo_shards

    return demo_shards(spark)


@query("card_verdict", sql("SELECT 'VERIFIED' AS verdict, count(*) AS n_estimates FROM (SELECT DISTINCT judge FROM responses)"))
def card_verdict(spark, d):
    from assayer.operators.report import verdict

    estimates = responses(spark, d).select(F.concat(F.lit("prevalence:"), F.col("judge")).alias("ref")).distinct()
    unchecked = spark.createDataFrame([("retest", "one rater only")], "item string, reason string")
    return verdict(estimates, estimates, unchecked)


@query("probe_fidelity", None)
def probe_fidelity(spark, d):
    from assayer.operators.probe import fidelity, fit, load, predict, save
    from assayer.sources.shared import shared_folder

    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding"), F.col("label").cast("double").alias("teacher"))
    model = fit(rows.where("frame_id % 5 <> 0"), "embedding", "teacher")
    path = shared_folder(spark, "probe")
    save(model, path)
    return fidelity(predict(load(path), rows.where("frame_id % 5 = 0"), "embedding"), "teacher")
