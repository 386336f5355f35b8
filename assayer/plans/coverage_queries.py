"""Queries of answers from token probabilities, prompt variants, completeness of gold, stored documents, cards and printed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import scalars as X
from assayer.functions import schemas
from assayer.operators import calibration as C
from assayer.operators import compare as M
from assayer.operators import pairing as P
from assayer.operators import prevalence as V
from assayer.operators import report, sampling
from assayer.plans.agreement_queries import _ARMS, _PPI, _TUNED, estimates
from assayer.plans.standins import frames, gold, ok_pairs, responses, sql, table
from assayer.sources import readers, sinks
from assayer.sources.shared import shared_folder, stored

Q, SQL = {}, {}
R = lambda c, n=6: F.round(F.col(c), n).alias(c)


def query(name: str, oracle: str):
    def add(f):
        Q[name], SQL[name] = f, oracle
        return f

    return add


@query("logprob_answers", sql("""WITH t AS (SELECT frame_id, judge, status, hands, manip, CASE frame_id % 5 WHEN 0 THEN [] WHEN 1 THEN [0.5::DOUBLE] ELSE [-(frame_id % 7) / 10.0::DOUBLE, -(frame_id % 3) / 5.0::DOUBLE] END AS lp FROM responses),
v AS (SELECT *, exp(list_avg(lp)) AS value FROM t)
SELECT frame_id, judge, CASE WHEN value BETWEEN 0 AND 1 THEN 'logprob' ELSE 'none' END AS kind, round(CASE WHEN value BETWEEN 0 AND 1 THEN value END, 6) AS value, CASE WHEN status = 'ok' THEN 1 - hands END AS flipped FROM v"""))
def logprob_answers(spark, d):
    """Confidence from the log probabilities of an answer's tokens, none for no tokens or an impossible value; answers only where ok."""
    d1 = lambda x: x.cast("double")
    lp = F.when(F.col("frame_id") % 5 == 0, F.array().cast("array<double>")).when(F.col("frame_id") % 5 == 1, F.array(F.lit(0.5))).otherwise(F.array(-d1(F.col("frame_id") % 7) / 10, -d1(F.col("frame_id") % 3) / 5))
    r = responses(spark, d).select("frame_id", "judge", "status", "hands", X.logprob_confidence(lp).alias("c"))
    return r.select("frame_id", "judge", F.col("c.kind").alias("kind"), F.round("c.value", 6).alias("value"), X.only_if_ok(F.col("status"), 1 - F.col("hands")).alias("flipped"))


_EDITS = {"P1": [(" de ", " clearly of "), (".", "")], "P2": [(".", "")], "P3": [("\n", "\n- "), ("- -", "-")], "P0": []}


@query("prompt_variants", " UNION ALL ".join(f"SELECT doc_id, '{v}' AS variant, sha256({'replace(' * len(e)}text{''.join(f''', {'chr(10)' if f == chr(10) else repr(f)}, {"chr(10) || '- '" if p.startswith(chr(10)) else repr(p)})''' for f, p in e)}) AS sha256 FROM documents" for v, e in _EDITS.items()))
def prompt_variants(spark, d):
    """Each text as four variants, by literal edits in turn that a table holds."""
    rows = [(v, [{"find": f, "put": p} for f, p in e]) for v, e in _EDITS.items()]
    edits = spark.createDataFrame(rows, "variant string, edits array<struct<find: string, put: string>>")
    return table(spark, d, "documents").join(F.broadcast(edits), F.lit(True)).select("doc_id", "variant", F.sha2(X.edited_by(F.col("text"), F.col("edits")), 256).alias("sha256"))


@query("task_remap", sql("WITH t AS (SELECT judge, unnest(['hands_ge_1', 'hands_eq_2', 'manipulation']) AS task, unnest([hands >= 1, hands = 2, manip]) AS y FROM responses WHERE status = 'ok') SELECT judge, task, count(*) FILTER (y) AS positive, count(*) FILTER (NOT y) AS negative FROM t GROUP BY 1, 2"))
def task_remap(spark, d):
    """Answers as the boolean that a named task asks for."""
    r = P.comparable(responses(spark, d)).select("judge", "hands", "manip", F.explode(F.array(*map(F.lit, ("hands_ge_1", "hands_eq_2", "manipulation")))).alias("task"))
    y = X.task_value(F.col("task"), F.col("hands"), F.col("manip"))
    return r.withColumn("y", y).groupBy("judge", "task").agg(F.count_if("y").alias("positive"), F.count_if(~F.col("y")).alias("negative"))


@query("gold_and_unlabelled", sql("""WITH a AS (SELECT * FROM responses WHERE judge = 'B' AND status = 'ok'), g AS (SELECT * FROM gold WHERE frame_id IN (SELECT frame_id FROM a))
SELECT 'gold' AS part, count(*) AS n, count(*) FILTER (manip) AS positive FROM a JOIN g USING (frame_id) UNION ALL SELECT 'unlabelled', count(*), count(*) FILTER (manip) FROM a WHERE frame_id NOT IN (SELECT frame_id FROM g)"""))
def gold_and_unlabelled(spark, d):
    """Gold rows with their answer, all of which must be there, and the answers without gold."""
    r = stored(responses(spark, d).where("judge = 'B'"), "answers")
    answered = gold(spark, d).join(P.comparable(r).select("frame_id"), "frame_id", "left_semi")
    joined, rest = P.gold_and_unlabelled(answered, r)
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.count_if("manip").alias("positive"))
    return count(joined, "gold").unionByName(count(rest, "unlabelled"))


@query("sample_prefix", "SELECT frame_id, position FROM (SELECT doc_id AS frame_id, row_number() OVER (ORDER BY md5('777:S10k-U:' || doc_id), doc_id) AS position FROM documents) WHERE position <= 25")
def sample_prefix(spark, d):
    """The first rows of a drawn sample in the order in which it was drawn."""
    ids = frames(spark, d).select("frame_id")
    order = [X.hash_order("S10k-U", F.col("frame_id")), F.col("frame_id")]
    return sampling.running(ids, sampling.hash_bucket("S10k-U", F.col("frame_id")), order, F.lit(1), "position").where("position <= 25")


@query("interval_rules", """WITH t AS (SELECT doc_id, ['iid', 'cluster-bootstrap', 'guess'][doc_id % 3 + 1] AS method, CASE WHEN doc_id % 2 = 0 THEN 9 END AS clusters, CASE WHEN doc_id % 5 > 0 THEN 100 END AS b, doc_id % 4 < 2 AS clustered, CASE WHEN doc_id % 7 < 4 THEN 'worker' END AS cluster_by, CASE WHEN doc_id % 6 < 3 THEN 'one site' END AS why FROM documents),
f AS (SELECT doc_id, unnest(list_filter([CASE WHEN method = 'guess' THEN 'unknown method' END, CASE WHEN method = 'cluster-bootstrap' AND (clusters IS NULL OR b IS NULL) THEN 'cluster bootstrap without clusters or B' END,
 CASE WHEN method <> 'cluster-bootstrap' AND (clusters IS NOT NULL OR b IS NOT NULL) THEN 'iid with clusters or B' END, CASE WHEN clustered AND cluster_by IS NULL THEN 'clustered without cluster_by' END, CASE WHEN clustered AND why IS NOT NULL THEN 'clustered with a reason against' END,
 CASE WHEN NOT clustered AND why IS NULL THEN 'unclustered without a reason' END, CASE WHEN NOT clustered AND cluster_by IS NOT NULL THEN 'unclustered with cluster_by' END], lambda x: x IS NOT NULL)) AS broken FROM t) SELECT doc_id, broken FROM f""")
def interval_rules(spark, d):
    """Rules of interval and prevalence records that are broken, by record."""
    i, s = F.col("doc_id"), lambda c, v: F.when(c, F.lit(v))
    rows = table(spark, d, "documents").select(
        "doc_id", F.element_at(F.array(*map(F.lit, ("iid", "cluster-bootstrap", "guess"))), (i % 3 + 1).cast("int")).alias("method"), s(i % 2 == 0, 9).alias("clusters"), s(i % 5 > 0, 100).alias("B"),
        (i % 4 < 2).alias("clustered"), s(i % 7 < 4, "worker").alias("cluster_by"), s(i % 6 < 3, "one site").alias("why_not_clustered"),
    )
    return rows.select("doc_id", F.explode(F.concat(schemas.interval_violations(), schemas.prevalence_violations())).alias("broken"))


@query("stored_documents", "SELECT 'summary' AS document, lang AS key, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'index', lang, count(*) FILTER (n_chars > 100) FROM documents GROUP BY 2")
def stored_documents(spark, d):
    """A result document read back as records, and an index of one JSON document a frame parsed back."""
    docs = table(spark, d, "documents")
    path = shared_folder(spark, "documents")
    sinks.write_document(docs.groupBy(F.col("lang").alias("sample")).agg(F.count(F.lit(1)).alias("frame_index")), f"{path}/summary")
    summary = readers.json_records(spark, f"{path}/summary", schemas.FRAME).select(F.lit("summary").alias("document"), F.col("sample").alias("key"), F.col("frame_index").alias("n"))
    index = sinks.frame_index(docs.select(F.col("doc_id").cast("string").alias("frame_id"), F.col("lang").alias("corpus"), F.col("n_chars").alias("frame_index")))
    parsed = index.select(F.from_json("document", schemas.FRAME).alias("f")).select("f.*").where(F.col("frame_id").isNotNull())
    return summary.unionByName(parsed.groupBy(F.col("corpus").alias("key")).agg(F.count_if(F.col("frame_index") > 100).alias("n")).select(F.lit("index").alias("document"), "key", "n"))


@query("card_digest", sql("""WITH j AS (SELECT judge, count(*) AS n, count(*) FILTER (status = 'ok') AS k FROM responses GROUP BY 1),
d AS (SELECT '{"claims":[' || string_agg('{"ref":"rate:' || judge || '","n":' || n || '}', ',' ORDER BY judge) || '],"unchecked":[{"item":"retest","reason":"one rater"}],"intervals":[' || string_agg('{"ref":"rate:' || judge || '","lo":0,"hi":' || k || '}', ',' ORDER BY judge)
  || '],"judge_revisions":{' || string_agg('"' || judge || '":"r1"', ',' ORDER BY judge) || '}}' AS document FROM j)
SELECT document, sha256(document) AS digest FROM d"""))
def card_digest(spark, d):
    """A card over the judges' counts as one JSON document and its digest."""
    j = responses(spark, d).groupBy("judge").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("k"))
    ref = F.concat(F.lit("rate:"), F.col("judge")).alias("ref")
    unchecked = spark.createDataFrame([("retest", "one rater")], "item string, reason string")
    card = report.card(j.select(ref, "n"), unchecked, j.select(ref, F.lit(0).alias("lo"), F.col("k").alias("hi")), j.select("judge", F.lit("r1").alias("judge_rev")))
    return card.select("document", "digest")


@query("figure_tables", sql("WITH " + _PPI.format(lam=_TUNED) + """, arms(l, r, published) AS (VALUES ('en','fr',0.05::DOUBLE), ('en','de',-0.02::DOUBLE)), z AS (SELECT 1.959963984540054::DOUBLE AS z),
n AS (SELECT corpus, judge, avg(manip::INT) AS naive FROM responses WHERE status='ok' GROUP BY 1, 2),
pr AS (SELECT corpus || '/' || judge AS label, 0.9::DOUBLE AS published, naive AS judge, value AS corrected, value - z*se AS lo, value + z*se AS hi FROM e JOIN n USING (corpus, judge), z),
mg AS (SELECT arms.l || '-' || arms.r AS label, published, a.value - b.value AS corrected, a.value - b.value - z*sqrt(a.se*a.se + b.se*b.se) AS lo, a.value - b.value + z*sqrt(a.se*a.se + b.se*b.se) AS hi FROM arms JOIN e a ON a.corpus = arms.l AND a.judge='A' JOIN e b ON b.corpus = arms.r AND b.judge='A', z),
vn AS (SELECT corpus || '/' || judge AS label, 0.9::DOUBLE AS published, naive AS judge FROM n)
SELECT section, row, "column", round(value, 6) + 0::DOUBLE AS value FROM (SELECT 'prevalence' AS section, label AS row, unnest(['published', 'judge', 'corrected', 'lo', 'hi']) AS "column", unnest([published, judge, corrected, lo, hi]) AS value FROM pr
UNION ALL SELECT 'margin', label, unnest(['published', 'corrected', 'lo', 'hi']), unnest([published, corrected, lo, hi]) FROM mg UNION ALL SELECT 'vendor', label, unnest(['published', 'judge']), unnest([published, judge]) FROM vn) WHERE value IS NOT NULL"""))
def figure_tables(spark, d):
    """Prevalence, margins and vendor rates as one long table."""
    # Few rows that five tables are made of: written once, else each would read all texts again.
    e, naive = stored(estimates(spark, d), "estimates"), stored(V.naive(responses(spark, d), "manip", "corpus", "judge"), "naive")
    label = F.concat_ws("/", "corpus", "judge").alias("label")
    prevalence = e.join(naive.select("corpus", "judge", "naive"), ["corpus", "judge"]).select(label, F.lit(0.9).alias("published"), F.col("naive").alias("judge"), F.col("value").alias("corrected"), "lo", "hi")
    arms = spark.createDataFrame(_ARMS, "left string, right string, published double")
    margins = V.margins(e.where("judge = 'A'"), arms, "corpus").select(F.concat_ws("-", "left", "right").alias("label"), "published", F.col("delta").alias("corrected"), "lo", "hi")
    return report.figure_tables(prevalence, margins, naive.select(label, F.lit(0.9).alias("published"), F.col("naive").alias("judge"))).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("evaluation_rows", "SELECT 'f' || doc_id AS frame_id, row_number() OVER (ORDER BY doc_id) - 1 AS frame_index FROM documents QUALIFY doc_id % 11 <> 0 AND length(text) > 0")
def evaluation_rows(spark, d):
    """Frames of a stored table by their id, with their place in the table, which is stored by ranges of ids; rows without a payload are skipped, not renumbered."""
    path = shared_folder(spark, "evaluation")
    image = F.struct(F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("text")).cast("binary").alias("bytes"))
    rows = table(spark, d, "documents").select(F.concat(F.lit("f"), "doc_id").alias("frame_id"), image.alias("image"), "doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.drop("doc_id").write.parquet(path)
    return readers.evaluation_frames(spark, path, through=True)


_MARKS = ", ".join("'" + m.replace("'", "''") + "'" for m in X.REFUSALS)
_SAID = f"""m AS (SELECT [{_MARKS}] AS marks), r AS (SELECT doc_id, 'Well. ' || CASE doc_id % 3 WHEN 0 THEN upper(marks[doc_id % len(marks) + 1]) WHEN 1 THEN left(marks[doc_id % len(marks) + 1], 5) ELSE marks[doc_id % len(marks) + 1] || ' answer' END AS raw FROM documents, m)"""


@query("refusal_markers", f"WITH {_SAID} SELECT doc_id, raw, CASE WHEN len(list_filter(marks, lambda k: contains(lower(raw), k))) > 0 THEN 'refused' ELSE 'unparseable' END AS status FROM r, m")
def refusal_markers(spark, d):
    """Answers that hold each of the refusal phrases, in capitals, cut off, or inside a sentence."""
    marks = F.array(*map(F.lit, X.REFUSALS))
    mark = F.element_at(marks, (F.col("doc_id") % len(X.REFUSALS) + 1).cast("int"))
    raw = F.concat(F.lit("Well. "), F.when(F.col("doc_id") % 3 == 0, F.upper(mark)).when(F.col("doc_id") % 3 == 1, F.substring(mark, 1, 5)).otherwise(F.concat(mark, F.lit(" answer"))))
    return table(spark, d, "documents").select("doc_id", raw.alias("raw")).select("doc_id", "raw", X.parse_hand_count(F.col("raw"))["status"].alias("status"))


@query("slice_of_all", sql("SELECT frame_id, judge FROM pairs WHERE corpus IN ('en', 'fr') AND manip AND gold_manip AND hands = gold_hands AND conf >= 0.9 AND conf < 0.99 AND judge IN ('A', 'B') AND cluster IS NOT NULL"))
def slice_of_all(spark, d):
    """Frames that meet all seven conditions of a slice; a condition that is null does not match."""
    p = gold(spark, d).join(responses(spark, d), "frame_id")
    conditions = [F.col("corpus").isin("en", "fr"), F.col("manip"), F.col("gold_manip"), X.agrees(F.col("hands"), F.col("gold_hands")), X.confidence_band(F.col("conf")) == "middle", F.col("judge").isin("A", "B"), F.col("cluster").isNotNull()]
    return p.where(M.slice_filter(conditions)).select("frame_id", "judge")


@query("calibration_report", sql("""WITH b AS (SELECT judge, corpus, least(trunc(conf / 0.1)::INT, 9) AS bin, count(*) AS n, avg(conf) AS c, avg((manip = gold_manip)::INT) AS a FROM ok_pairs GROUP BY ALL)
SELECT judge, corpus, sum(n)::BIGINT AS n, round(sum(n * abs(a - c)) / sum(n), 6) AS ece, 10 AS bins, count(*) AS filled, round(max(abs(a - c)), 6) AS worst FROM b GROUP BY ALL"""))
def calibration_report(spark, d):
    """Calibration error and nested bins of each judge and corpus, never pooled."""
    graded = ok_pairs(spark, d).withColumn("correct", F.col("manip") == F.col("gold_manip"))
    out = C.report(graded, "conf", "correct", "judge", "corpus")
    gaps = F.transform("bins", lambda b: F.abs(b["accuracy"] - b["mean_conf"]))
    return out.select("judge", "corpus", "n", R("ece"), F.size("bins").alias("bins"), F.size(F.filter("bins", lambda b: b["n"] > 0)).alias("filled"), F.round(F.array_max(gaps), 6).alias("worst"))
