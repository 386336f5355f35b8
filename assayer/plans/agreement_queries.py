"""Queries for pairing, agreement, confusion, prevalence and margins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import agreement as A
from assayer.operators import pairing as P
from assayer.operators import prevalence as V
from assayer.operators import sensitivity as S
from assayer.plans.standins import all_pairs, gold, ok_pairs, responses, sql

Q, SQL = {}, {}
R = lambda c, n=6: F.round(F.col(c), n).alias(c)


def query(name: str, oracle: str):
    def add(f):
        Q[name], SQL[name] = f, oracle
        return f

    return add


_AC1 = """
cells AS (SELECT {by} judge, count(*) AS n, avg((manip = gold_manip)::INT) AS raw, avg(manip::INT) AS pa, avg(gold_manip::INT) AS pb FROM ok_pairs GROUP BY ALL),
chance AS (SELECT *, (pa + pb) / 2 AS p1 FROM cells),
stats AS (SELECT {by} judge, n, raw, 2 * p1 * (1 - p1) AS e1, pa * pb + (1 - pa) * (1 - pb) AS e2 FROM chance)
SELECT {by} judge, n, round(raw, 6) AS raw, round(CASE WHEN e1 >= 1 THEN 1 ELSE (raw - e1) / (1 - e1) END, 6) AS ac1,
  round(CASE WHEN e2 >= 1 THEN 1 ELSE (raw - e2) / (1 - e2) END, 6) AS kappa FROM stats
"""


def _agree(spark, d, *by):
    return A.agreement(ok_pairs(spark, d), "manip", "gold_manip", (False, True), *by, "judge").select(*by, "judge", "n", R("raw"), R("ac1"), R("kappa"))


@query("agreement_by_lang", sql("WITH " + _AC1.format(by="corpus,")))
def agreement_by_lang(spark, d):
    return _agree(spark, d, "corpus")


@query("agreement_by_judge", sql("WITH " + _AC1.format(by="")))
def agreement_by_judge(spark, d):
    return _agree(spark, d)


@query(
    "agreement_hands",
    sql("""WITH m AS (SELECT judge, count(*) AS n, avg((hands = gold_hands)::INT) AS raw, avg((hands=0)::INT) a0, avg((hands=1)::INT) a1, avg((hands=2)::INT) a2,
  avg((gold_hands=0)::INT) b0, avg((gold_hands=1)::INT) b1, avg((gold_hands=2)::INT) b2 FROM ok_pairs GROUP BY 1),
e AS (SELECT judge, n, raw, ((a0+b0)/2*(1-(a0+b0)/2) + (a1+b1)/2*(1-(a1+b1)/2) + (a2+b2)/2*(1-(a2+b2)/2)) / 2 AS e1, a0*b0 + a1*b1 + a2*b2 AS e2 FROM m)
SELECT judge, n, round(raw, 6) AS raw, round((raw-e1)/(1-e1), 6) AS ac1, round((raw-e2)/(1-e2), 6) AS kappa FROM e"""),
)
def agreement_hands(spark, d):
    return A.agreement(ok_pairs(spark, d), "hands", "gold_hands", (0, 1, 2), "judge").select("judge", "n", R("raw"), R("ac1"), R("kappa"))


@query("marginals", sql("SELECT judge, corpus, round(avg((hands=0)::INT),6) p_0, round(avg((hands=1)::INT),6) p_1, round(avg((hands=2)::INT),6) p_2 FROM ok_pairs GROUP BY 1,2"))
def marginals(spark, d):
    return A.marginals(ok_pairs(spark, d), "hands", (0, 1, 2), "judge", "corpus").select("judge", "corpus", R("p_0"), R("p_1"), R("p_2"))


@query("exclusions_by_reason", sql("SELECT judge, status, count(*) AS n FROM pairs WHERE status <> 'ok' GROUP BY 1, 2"))
def exclusions_by_reason(spark, d):
    return P.exclusions(all_pairs(spark, d), "judge")


@query("exclusion_map", sql("SELECT judge, count(*) AS n_excluded, count(*) FILTER (status='refused') AS refused, count(*) FILTER (status='timeout') AS timeout, count(*) FILTER (status='unparseable') AS unparseable FROM pairs WHERE status <> 'ok' GROUP BY 1"))
def exclusion_map(spark, d):
    m = P.exclusion_map(all_pairs(spark, d), "judge")
    return m.select("judge", "n_excluded", *[F.coalesce(F.col("excluded_why")[s], F.lit(0)).alias(s) for s in ("refused", "timeout", "unparseable")])


@query("fleiss_panel", sql("""WITH full_ AS (SELECT frame_id FROM responses WHERE status='ok' GROUP BY 1 HAVING count(DISTINCT judge) = 3),
per AS (SELECT corpus, frame_id, sum(manip::INT) AS c1, 3 - sum(manip::INT) AS c0 FROM responses JOIN full_ USING (frame_id) WHERE status='ok' GROUP BY 1, 2),
s AS (SELECT corpus, count(*) AS n_frames, avg((c1*c1 + c0*c0 - 3) / 6.0::DOUBLE) AS raw, sum(c1) / (3.0::DOUBLE * count(*)) AS p1 FROM per GROUP BY 1)
SELECT corpus, n_frames, 3 AS k, round((raw - (p1*p1 + (1-p1)*(1-p1))) / (1 - (p1*p1 + (1-p1)*(1-p1))), 6) AS fleiss FROM s"""))
def fleiss_panel(spark, d):
    complete = P.complete_panel(responses(spark, d), "judge")
    return A.fleiss_kappa(complete, "manip", (False, True), "frame_id", "corpus").select("corpus", "n_frames", F.col("k").cast("int").alias("k"), R("fleiss"))


@query("error_dependence", sql("""WITH e AS (SELECT frame_id, judge, (manip <> gold_manip)::INT AS e FROM ok_pairs),
c AS (SELECT a.judge AS ja, b.judge AS jb, sum(a.e*b.e) AS n11, sum(a.e) AS n1, sum(b.e) AS m1, count(*) AS n FROM e a JOIN e b ON a.frame_id = b.frame_id AND a.judge < b.judge GROUP BY 1,2)
SELECT count(*) AS n_pairs, round(avg(CASE WHEN n1*(n-n1)*m1*(n-m1) > 0 THEN (n*n11 - n1*m1) / sqrt((n1*(n-n1)*m1*(n-m1))::DOUBLE) ELSE 0 END), 6) AS phi FROM c"""))
def error_dependence(spark, d):
    return A.error_dependence(gold(spark, d), responses(spark, d), "gold_manip", "manip").select("n_pairs", R("phi"))


@query("confusion_hands", sql("SELECT corpus, judge, hands AS judge_answer, gold_hands AS rater_answer, count(*) AS n FROM ok_pairs GROUP BY ALL"))
def confusion_hands(spark, d):
    return A.confusion(ok_pairs(spark, d), "hands", "gold_hands", "corpus", "judge")


@query("confusion_manipulation", sql("SELECT judge, manip AS judge_answer, gold_manip AS rater_answer, count(*) AS n FROM ok_pairs GROUP BY ALL"))
def confusion_manipulation(spark, d):
    return A.confusion(ok_pairs(spark, d), "manip", "gold_manip", "judge")


@query("error_direction", sql("SELECT judge, count(*) FILTER (hands > gold_hands) AS over, count(*) FILTER (gold_hands < 2) AS can_over, count(*) FILTER (hands < gold_hands) AS under, count(*) FILTER (gold_hands > 0) AS can_under, count(*) FILTER (gold_hands = 1 AND hands = 2) AS one_to_two FROM ok_pairs GROUP BY 1"))
def error_direction(spark, d):
    return A.error_direction(ok_pairs(spark, d), "hands", "gold_hands", 2, "judge")


@query("error_direction_subsets", sql("""WITH cut AS (SELECT 'all' AS subset, * FROM ok_pairs UNION ALL SELECT 'later', * FROM ok_pairs WHERE frame_id >= 200 UNION ALL SELECT 'effort', * FROM ok_pairs WHERE conf >= 0.5)
SELECT subset, judge, count(*) FILTER (hands > gold_hands) AS over, count(*) FILTER (gold_hands < 2) AS can_over, count(*) FILTER (hands < gold_hands) AS under, count(*) FILTER (gold_hands > 0) AS can_under, count(*) FILTER (gold_hands = 1 AND hands = 2) AS one_to_two FROM cut GROUP BY 1, 2"""))
def error_direction_subsets(spark, d):
    p = ok_pairs(spark, d)
    named = p.withColumn("subset", F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("frame_id") >= 200, "later"), F.when(F.col("conf") >= 0.5, "effort")), lambda x: x.isNotNull())))
    return A.error_direction(named, "hands", "gold_hands", 2, "subset", "judge")


@query("domain_bias", sql("""WITH r AS (SELECT avg(CASE WHEN corpus='en' THEN (manip <> gold_manip)::INT END) AS l, avg(CASE WHEN corpus='fr' THEN (manip <> gold_manip)::INT END) AS r FROM ok_pairs WHERE judge='A')
SELECT round(l,6) AS left_error, round(r,6) AS right_error, round((r-l)*100,6) AS gap_pp, abs((r-l)*100) >= 5 AS biased FROM r"""))
def domain_bias(spark, d):
    return A.error_rate_gap(ok_pairs(spark, d).where("judge = 'A'"), "manip", "gold_manip", "corpus", "en", "fr").select(R("left_error"), R("right_error"), R("gap_pp"), "biased")


@query("label_distribution", sql("SELECT corpus, count(*) FILTER (gold_hands=0) AS hands_0, count(*) FILTER (gold_hands=1) AS hands_1, count(*) FILTER (gold_hands=2) AS hands_2, count(*) FILTER (NOT gold_manip) AS no, count(*) FILTER (gold_manip) AS yes FROM gold JOIN frames USING (frame_id) GROUP BY 1"))
def label_distribution(spark, d):
    from assayer.plans.standins import frames

    g = gold(spark, d).join(frames(spark, d), "frame_id")
    return g.groupBy("corpus").agg(*[F.count_if(F.col("gold_hands") == i).alias(f"hands_{i}") for i in range(3)], F.count_if(~F.col("gold_manip")).alias("no"), F.count_if(F.col("gold_manip")).alias("yes"))


_PPI = """
g AS (SELECT corpus, judge, count(*) AS n, avg(gold_manip::INT) ym, avg(manip::INT) fm, coalesce(var_samp(gold_manip::INT),0) yv, coalesce(var_samp(manip::INT),0) fv, coalesce(covar_samp(manip::INT, gold_manip::INT),0) cv FROM ok_pairs GROUP BY 1,2),
u AS (SELECT corpus, judge, count(*) AS n_unlabelled, avg(manip::INT) um, coalesce(var_samp(manip::INT),0) uv FROM responses WHERE status='ok' AND frame_id NOT IN (SELECT frame_id FROM gold) GROUP BY 1,2),
l AS (SELECT *, {lam} AS lam FROM g JOIN u USING (corpus, judge)),
p AS (SELECT corpus, judge, n, n_unlabelled, lam, ym - lam*fm AS rectifier, lam*um + ym - lam*fm AS value, greatest(yv - 2*lam*cv + lam*lam*fv, 0) AS var_gold, lam*lam*uv/n_unlabelled AS var_unlabelled FROM l),
e AS (SELECT *, sqrt(var_gold/n + var_unlabelled) AS se FROM p)
"""
_TUNED = "CASE WHEN fv > 0 THEN greatest(0, least(1, cv/fv)) ELSE 0 END"
_PPI_SELECT = "SELECT corpus, judge, n, n_unlabelled, round(lam,6) AS lam, round(rectifier,6) + 0::DOUBLE AS rectifier, round(value,6) AS value, round(value - 1.959963984540054*se,6) AS lo, round(value + 1.959963984540054*se,6) AS hi FROM e"


def estimates(spark, d, tuned=True):
    r = responses(spark, d).where("status = 'ok'").select("frame_id", "corpus", "judge", "manip")
    beside = r.join(gold(spark, d).withColumn("there", F.lit(True)), "frame_id", "left").withColumn("there", F.col("there").isNotNull())
    return V.ppi(V.moments_by_presence(beside, "gold_manip", "manip", "there", "corpus", "judge"), tuned)


def _ppi_columns(e):
    return e.select("corpus", "judge", "n", "n_unlabelled", *[(R(c) + F.lit(0.0)).alias(c) for c in ("lam", "rectifier", "value", "lo", "hi")])


@query("prevalence_ppi_plus", sql("WITH " + _PPI.format(lam=_TUNED) + _PPI_SELECT))
def prevalence_ppi_plus(spark, d):
    return _ppi_columns(estimates(spark, d))


@query("prevalence_ppi_classical", sql("WITH " + _PPI.format(lam="1.0::DOUBLE") + _PPI_SELECT))
def prevalence_ppi_classical(spark, d):
    return _ppi_columns(estimates(spark, d, False))


@query("ppi_variance_split", sql("WITH " + _PPI.format(lam=_TUNED) + "SELECT corpus, judge, n, n_unlabelled, round(var_gold,8) AS var_gold, round(var_unlabelled,8) AS var_unlabelled, round(se,8) AS se FROM e"))
def ppi_variance_split(spark, d):
    return estimates(spark, d).select("corpus", "judge", "n", "n_unlabelled", R("var_gold", 8), R("var_unlabelled", 8), R("se", 8))


@query("prevalence_naive", sql("SELECT corpus, judge, round(avg(manip::INT),6) AS naive, count(*) AS n_naive FROM responses WHERE status='ok' GROUP BY 1,2"))
def prevalence_naive(spark, d):
    return V.naive(responses(spark, d), "manip", "corpus", "judge").select("corpus", "judge", R("naive"), "n_naive")


_ARMS = [("en", "fr", 0.05), ("en", "de", -0.02)]


@query("margins", sql("WITH " + _PPI.format(lam=_TUNED) + """, arms(l, r, published) AS (VALUES ('en','fr',0.05::DOUBLE), ('en','de',-0.02::DOUBLE)),
m AS (SELECT arms.l AS "left", arms.r AS "right", published, a.value - b.value AS delta, sqrt(a.se*a.se + b.se*b.se) AS se FROM arms JOIN e a ON a.corpus = arms.l AND a.judge='A' JOIN e b ON b.corpus = arms.r AND b.judge='A')
SELECT "left", "right", published, round(delta,6) AS delta, round(se,6) AS se, round(delta - 1.959963984540054*se,6) AS lo, round(delta + 1.959963984540054*se,6) AS hi,
 published BETWEEN delta - 1.959963984540054*se AND delta + 1.959963984540054*se AS inside, sign(published)*sign(delta) < 0 AS flipped FROM m"""))
def margins(spark, d):
    arms = spark.createDataFrame(_ARMS, "left string, right string, published double")
    return V.margins(estimates(spark, d).where("judge = 'A'"), arms, "corpus").select("left", "right", "published", R("delta"), R("se"), R("lo"), R("hi"), "inside", "flipped")


@query("gold_needed", sql("WITH " + _PPI.format(lam=_TUNED) + """, two AS (SELECT a.judge, a.var_gold AS v1, b.var_gold AS v2, sqrt(a.var_unlabelled + b.var_unlabelled) AS f FROM e a JOIN e b USING (judge) WHERE a.corpus='en' AND b.corpus='fr')
SELECT judge, round(f,8) AS floor_se, CASE WHEN 0.02 > f THEN ceil((v1+v2)/(0.02*0.02 - f*f))::BIGINT END AS n_gold FROM two"""))
def gold_needed(spark, d):
    e = estimates(spark, d)
    side = lambda c, p: e.where(F.col("corpus") == c).select("judge", F.col("var_gold").alias(f"{p}_gold"), F.col("var_unlabelled").alias(f"{p}_un"))
    both = side("en", "l").join(side("fr", "r"), "judge").withColumn("floor_se", F.sqrt(F.col("l_un") + F.col("r_un")))
    return both.select("judge", R("floor_se", 8), V.gold_needed(F.col("l_gold"), F.col("r_gold"), F.col("floor_se"), F.lit(0.02)).alias("n_gold"))


@query("headline_rates", sql("""SELECT corpus, judge, count(*) FILTER (status='ok') AS n_ok, round(coalesce(avg((hands>=1)::INT),0),6) AS at_least_one, round(coalesce(avg((hands=2)::INT),0),6) AS two_hands, round(coalesce(avg(manip::INT),0),6) AS manipulation,
 count(*) FILTER (status='refused') AS n_refused, count(*) FILTER (status='unparseable') AS n_unparseable, count(*) FILTER (status='timeout') AS n_timeout, count(*) FILTER (status='error') AS n_error FROM responses GROUP BY 1,2"""))
def headline_rates(spark, d):
    r = responses(spark, d).withColumnsRenamed({"hands": "hands_visible", "manip": "manipulation"})
    h = S.headline_rates(r, "corpus", "judge")
    return h.select("corpus", "judge", "n_ok", R("at_least_one"), R("two_hands"), R("manipulation"), "n_refused", "n_unparseable", "n_timeout", "n_error")


@query("replication_verdicts", sql("""WITH h AS (SELECT corpus, judge, avg(manip::INT) AS observed FROM responses WHERE status='ok' GROUP BY 1,2), p AS (SELECT corpus, judge, observed, 0.9::DOUBLE AS published FROM h)
SELECT corpus, judge, round(abs(observed-published)*100,6) AS gap_pp, abs(observed-published)*100 <= 2 AS within FROM p"""))
def replication_verdicts(spark, d):
    h = V.naive(responses(spark, d), "manip", "corpus", "judge").withColumn("published", F.lit(0.9))
    gap, within = S.within_tolerance("naive", "published")
    return h.select("corpus", "judge", gap, within).withColumn("gap_pp", F.round("gap_pp", 6))


@query("variant_spread", sql("""WITH r AS (SELECT judge, avg(manip::INT) AS rate FROM responses WHERE status='ok' GROUP BY 1), s AS (SELECT (max(rate)-min(rate))*100 AS sp, (max(CASE WHEN judge='C' THEN rate END) - max(CASE WHEN judge='A' THEN rate END))*100 AS sh FROM r)
SELECT round(sp,6) AS spread_pp, sp >= 5 AS sensitive, round(sh,6) AS shift_pp, abs(sh) >= 2 AS shifted FROM s"""))
def variant_spread(spark, d):
    return S.spread(V.naive(responses(spark, d), "manip", "judge"), "naive", "judge", "A", "C").select(R("spread_pp"), "sensitive", R("shift_pp"), "shifted")


@query("unanimity", sql("""WITH full_ AS (SELECT frame_id FROM responses WHERE status='ok' GROUP BY 1 HAVING count(*) = 3),
per AS (SELECT frame_id, sum(manip::INT) AS k FROM responses JOIN full_ USING (frame_id) GROUP BY 1)
SELECT count(*) AS n, round(avg((k IN (0,3))::INT),6) AS ipr, round(avg(CASE WHEN k IN (0,3) THEN 1.0::DOUBLE ELSE 1/3.0::DOUBLE END),6) AS par FROM per"""))
def unanimity(spark, d):
    return S.unanimity(P.complete_panel(responses(spark, d), "judge"), "manip").select("n", R("ipr"), R("par"))


@query("unlabelled_pool", sql("SELECT judge, count(*) AS n FROM responses WHERE status='ok' AND frame_id NOT IN (SELECT frame_id FROM gold) GROUP BY 1"))
def unlabelled_pool(spark, d):
    _, pool = P.gold_and_unlabelled(gold(spark, d).where("false"), responses(spark, d))
    return pool.join(gold(spark, d).select("frame_id"), "frame_id", "left_anti").groupBy("judge").agg(F.count(F.lit(1)).alias("n"))


@query("pending_frames", "SELECT doc_id AS frame_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_frames(spark, d):
    from assayer.plans.standins import frames

    return P.pending(frames(spark, d).select("frame_id"), gold(spark, d))


@query("published_comparison", sql("""SELECT judge, count(*) AS n_ok, count(gold_manip) AS n_compared, round(avg(CASE WHEN gold_manip IS NOT NULL THEN (manip = gold_manip)::INT END),6) AS agreement FROM responses LEFT JOIN gold USING (frame_id) WHERE status='ok' GROUP BY 1"""))
def published_comparison(spark, d):
    r = responses(spark, d).where("status = 'ok'").join(gold(spark, d), "frame_id", "left")
    return r.groupBy("judge").agg(F.count(F.lit(1)).alias("n_ok"), F.count("gold_manip").alias("n_compared"), F.round(F.avg((F.col("manip") == F.col("gold_manip")).cast("double")), 6).alias("agreement"))


@query("differing_pairs", sql("SELECT frame_id, judge FROM ok_pairs WHERE hands <> gold_hands OR manip <> gold_manip"))
def differing_pairs(spark, d):
    p = ok_pairs(spark, d)
    return p.where(~F.col("hands").eqNullSafe(F.col("gold_hands")) | ~F.col("manip").eqNullSafe(F.col("gold_manip"))).select("frame_id", "judge")
