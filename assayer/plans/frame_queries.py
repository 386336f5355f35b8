"""Queries for pools, arms, wide rows, slices, checks of records and figures, judges, readers and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from assayer.functions import schemas, vocab
from assayer.operators import frames as O
from assayer.operators import report, sampling
from assayer.operators.judging import judge_frames
from assayer.plans.standins import frames, gold, responses, sql, table
from assayer.plans.stat_queries import _DRAW
from assayer.sources import readers, sinks
from assayer.sources.shared import shared_folder, stored

Q, SQL = {}, {}


def query(name: str, oracle: str):
    def add(f):
        Q[name], SQL[name] = f, oracle
        return f

    return add


def _docs(spark, d):
    return table(spark, d, "documents")


def _ids(spark, d):
    return frames(spark, d).select("frame_id", "corpus", "cluster")


def _label_ids(spark, d, where: str = "true"):
    return table(spark, d, "labels").where(where).select(F.col("doc_id").alias("frame_id"))


@query("frame_per_clip", f"SELECT doc_id AS clip, {_DRAW.format(name='clip', parts='doc_id', mod='n_chars')} AS frame_index FROM documents WHERE n_chars >= 1")
def frame_per_clip(spark, d):
    return O.frame_per_clip(_docs(spark, d).select(F.col("doc_id").alias("clip"), "n_chars"), "clip", "clip", "n_chars").select("clip", "frame_index")


@query("next_frame", "SELECT doc_id AS frame_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5('777:next:' || doc_id), doc_id LIMIT 1")
def next_frame(spark, d):
    return O.next_frame(_ids(spark, d), gold(spark, d), "next").select("frame_id")


@query("training_labels", "SELECT doc_id AS frame_id, (quality + toxic)::INT AS hands, quality = 1 AS manip FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) AND doc_id NOT IN (SELECT doc_id FROM documents ORDER BY md5('777:holdout:' || doc_id), doc_id LIMIT 100)")
def training_labels(spark, d):
    ids = _ids(spark, d)
    return O.training_labels(ids, sampling.uniform(ids, "holdout", 100), gold(spark, d)).select("frame_id", F.col("gold_hands").cast("int").alias("hands"), F.col("gold_manip").alias("manip"))


@query("unknown_ids", "SELECT DISTINCT user_id AS frame_id FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels)")
def unknown_ids(spark, d):
    return O.unknown_ids(table(spark, d, "events").select(F.col("user_id").alias("frame_id")), gold(spark, d))


@query("vendor_arm", sql("""WITH ga AS (SELECT frame_id, 'B' AS judge, hands::INT AS hands_visible, manip AS manipulation FROM ok_pairs WHERE judge = 'B')
SELECT * FROM ga UNION ALL SELECT frame_id, 'vendor', gold_hands::INT, gold_manip FROM gold JOIN frames USING (frame_id) WHERE corpus = 'en' AND frame_id NOT IN (SELECT frame_id FROM ga)"""))
def vendor_arm(spark, d):
    labels = gold(spark, d)
    answers = responses(spark, d, labels).where("judge = 'B' and status = 'ok'").select("frame_id", "judge", F.col("hands").alias("hands_visible"), F.col("manip").alias("manipulation"))
    return O.vendor_arm(answers, labels, _ids(spark, d).where("corpus = 'en'"), "vendor", "gold_hands", "gold_manip")


@query("extraction_failures", "SELECT doc_id AS frame_id, 'error' AS status, 'extraction-failed' AS judge_rev, length(substr('DecodeError: ' || text, 1, 2000))::INT AS n, sha256(substr('DecodeError: ' || text, 1, 2000)) AS raw_sha256 FROM documents")
def extraction_failures(spark, d):
    failed = O.extraction_failures(frames(spark, d), "A", F.lit("DecodeError"), F.col("text"))
    return failed.select("frame_id", "status", "judge_rev", F.length("raw").alias("n"), F.sha2("raw", 256).alias("raw_sha256"))


@query("wide_frames", sql("""SELECT f.frame_id, corpus, a.status AS judge_status, a.hands AS judge_hands, b.hands AS vendor_hands, g.gold_hands::INT AS rater_hands, g.gold_manip AS rater_manip, c.status AS reread_status
FROM frames f JOIN (SELECT * FROM responses WHERE judge = 'A') a USING (frame_id, corpus) LEFT JOIN (SELECT * FROM responses WHERE judge = 'B' AND status = 'ok') b USING (frame_id) LEFT JOIN gold g USING (frame_id) LEFT JOIN (SELECT * FROM responses WHERE judge = 'C') c USING (frame_id)"""))
def wide_frames(spark, d):
    answers = stored(responses(spark, d).select("frame_id", "judge", "status", "hands"), "answers")
    of = lambda j: answers.where(F.col("judge") == j).select("frame_id", "status", "hands")
    wide = O.wide_frames(_ids(spark, d), of("A"), ["corpus", "frame_id"], vendor=of("B").where("status = 'ok'"), rater=gold(spark, d), reread=of("C"))
    return wide.select("frame_id", "corpus", F.col("judge.status").alias("judge_status"), F.col("judge.hands").alias("judge_hands"), F.col("vendor.hands").alias("vendor_hands"), F.col("rater.gold_hands").cast("int").alias("rater_hands"), F.col("rater.gold_manip").alias("rater_manip"), F.col("reread.status").alias("reread_status"))


@query("reason_counts", sql("SELECT judge, corpus, count(*) FILTER (manip AND NOT gold_manip) AS judge_yes_rater_no, count(*) FILTER (NOT manip AND gold_manip) AS judge_no_rater_yes, count(*) FILTER (manip IS NULL) AS unparsed FROM pairs GROUP BY 1, 2"))
def reason_counts(spark, d):
    labels = gold(spark, d)
    return O.reason_counts(labels.join(responses(spark, d, labels), "frame_id"), "manip", "gold_manip", "judge", "corpus")


_TIERS = "t AS (SELECT doc_id AS frame_id, CASE WHEN toxic = 1 THEN 'withheld' WHEN toxic = 0 THEN 'shipped' ELSE 'remote' END AS tier FROM documents LEFT JOIN labels USING (doc_id))"


@query("tiers", f"WITH {_TIERS} SELECT tier, count(*) AS n FROM t GROUP BY 1")
def tiers(spark, d):
    return O.tiers(_ids(spark, d), _label_ids(spark, d), _label_ids(spark, d, "toxic = 1")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("tier_preview", f"WITH {_TIERS}, r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY frame_id) AS place FROM t) SELECT tier, frame_id, place::INT AS place FROM r WHERE place <= 12")
def tier_preview(spark, d):
    from pyspark.sql import Window

    tiered = O.tiers(_ids(spark, d), _label_ids(spark, d), _label_ids(spark, d, "toxic = 1"))
    return tiered.select("tier", "frame_id", F.row_number().over(Window.partitionBy("tier").orderBy("frame_id")).alias("place")).where("place <= 12")


@query("eligible_tiles", "SELECT doc_id AS frame_id, CASE WHEN quality = 1 THEN 'eligible' ELSE 'awaiting review' END AS state FROM labels WHERE toxic <> 1")
def eligible_tiles(spark, d):
    return O.eligible_tiles(_label_ids(spark, d), _label_ids(spark, d, "quality = 1"), _label_ids(spark, d, "toxic = 1"))


_KINDS = "k AS (SELECT *, CASE frame_id % 3 WHEN 0 THEN 'logprob' WHEN 1 THEN 'verbalized' ELSE 'none' END AS kind, CASE WHEN frame_id % 3 <> 2 AND frame_id % 7 <> 0 THEN conf END AS value FROM responses)"


def _with_kinds(rows):
    kind = F.when(F.col("frame_id") % 3 == 0, "logprob").when(F.col("frame_id") % 3 == 1, "verbalized").otherwise("none")
    value = F.when((F.col("frame_id") % 3 != 2) & (F.col("frame_id") % 7 != 0), F.col("conf"))
    return rows.withColumn("confidence", F.struct(kind.alias("kind"), value.alias("value")))


@query("logprob_confidences", sql(f"WITH {_KINDS} SELECT judge, count(*) AS n, round(avg(value), 6) AS mean_conf FROM k WHERE kind = 'logprob' AND value IS NOT NULL GROUP BY 1"))
def logprob_confidences(spark, d):
    kept = O.of_one_kind(_with_kinds(responses(spark, d)), "logprob")
    return kept.groupBy("judge").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence.value"), 6).alias("mean_conf"))


@query("answer_matches", sql("SELECT judge, count(*) FILTER (manip) AS yes, count(*) FILTER (NOT manip) AS no, count(*) FILTER (hands = 0) AS none, count(*) FILTER (hands = 1) AS one, count(*) FILTER (hands = 2) AS two FROM responses GROUP BY 1"))
def answer_matches(spark, d):
    asked = {"yes": ("manipulation", "yes"), "no": ("manipulation", "no"), "none": ("hands", "0"), "one": ("hands", "1"), "two": ("hands", "2")}
    return responses(spark, d).groupBy("judge").agg(*[F.count_if(O.answer_matches(task, wanted, F.col("hands"), F.col("manip"))).alias(name) for name, (task, wanted) in asked.items()])


@query("disagreeing_counts", "SELECT corpus, f.n AS found, p.n AS published FROM (SELECT lang AS corpus, count(*) AS n FROM documents GROUP BY 1) f FULL JOIN (SELECT lang AS corpus, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) p USING (corpus) WHERE coalesce(abs(f.n - p.n) > 10, true)")
def disagreeing_counts(spark, d):
    ids = _ids(spark, d)
    count = lambda x: x.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    return O.disagreeing_counts(count(ids), count(ids.join(_label_ids(spark, d), "frame_id")), ["corpus"], "n", 10)


_TAGS = "n AS (SELECT n_regionkey, n_nationkey, lower(regexp_replace(translate(n_name, '0123456789', 'abcdefghij'), '[^A-Za-z]', '-', 'g')) AS tag FROM nation)"


@query("tag_sets", f"WITH {_TAGS} SELECT n_regionkey, string_agg(DISTINCT tag, ',' ORDER BY tag) AS closed, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag) FILTER (n_nationkey % 2 = 1), '') AS orphans FROM n GROUP BY 1")
def tag_sets(spark, d):
    from assayer.operators.compare import shared_tags

    tag = F.lower(F.regexp_replace(F.translate("n_name", "0123456789", "abcdefghij"), "[^A-Za-z]", "-"))
    listed = F.concat(F.lit("- `"), tag, F.lit("`"))
    rule = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Rule. Tagged\n`"), tag, F.lit("`.")))
    text = F.concat(F.lit("# Rubric\n\n## Tag list, closed\n\n"), F.array_join(F.collect_list(listed), "\n"), F.lit("\n\n"), F.array_join(F.collect_list(rule), "\n"))
    rubrics = table(spark, d, "nation").groupBy("n_regionkey").agg(text.alias("text"))
    closed = O.closed_tags(F.col("text"), "## Tag list, closed")
    orphans, _ = shared_tags(closed, O.referenced_tags(F.col("text")))
    return rubrics.select("n_regionkey", F.array_join(closed, ",").alias("closed"), F.array_join(orphans, ",").alias("orphans"))


@query("printed_figures", "SELECT lang, printf('%.2f', avg(quality) * 100) AS share, format('{:,}', sum(n_chars)::BIGINT) AS characters, count(*)::VARCHAR AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def printed_figures(spark, d):
    per = _docs(spark, d).join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("rate"), F.sum("n_chars").alias("characters"), F.count(F.lit(1)).alias("n"))
    document = F.to_json(F.struct(F.struct("rate").alias("quality"), F.array("characters", "n").alias("sizes")))
    return per.select("lang", document.alias("j")).select("lang", O.figure(F.col("j"), "quality.rate", "pct2").alias("share"), O.figure(F.col("j"), "sizes.0", "int_comma").alias("characters"), O.figure(F.col("j"), "sizes.1", "raw_int").alias("n"))


@query("stale_figures", "SELECT doc_id FROM documents WHERE NOT contains(text, lang || ' ')")
def stale_figures(spark, d):
    return O.stale_figures(_docs(spark, d).select("doc_id", "text", F.concat("lang", F.lit(" ")).alias("literal"))).select("doc_id")


@query("judge_seam", "SELECT doc_id AS frame_id, 'D' AS judge, least(2, length(text) - length(replace(text, '!', '')))::INT AS hands_visible, NOT contains(text, '!') AS manipulation, 'ok' AS status FROM documents")
def judge_seam(spark, d):
    def ask(texts: pd.Series) -> pd.DataFrame:
        marks = texts.str.count("!")
        return pd.DataFrame({"hands_visible": marks.clip(upper=2), "manipulation": marks == 0, "raw": marks.astype(str)})

    return judge_frames(frames(spark, d), "D", "rule-1", "P0", ask, "text").select("frame_id", "judge", "hands_visible", "manipulation", "status")


@query("sorted_variants", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS variants FROM events GROUP BY 1")
def sorted_variants(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("variants"))


_BROKEN = {
    "unknown status": "status NOT IN " + str(vocab.STATUSES), "hands outside 0 to 2": "hands NOT BETWEEN 0 AND 2", "ok without answers": "status = 'ok' AND (hands IS NULL OR manip IS NULL)",
    "answers without ok": "status <> 'ok' AND (hands IS NOT NULL OR manip IS NOT NULL)", "value without kind": "kind = 'none' AND value IS NOT NULL", "kind without value": "kind <> 'none' AND value IS NULL",
}
_SPOILT = "s AS (SELECT judge, kind, value, CASE WHEN frame_id % 13 = 0 THEN 'lost' ELSE status END AS status, CASE WHEN frame_id % 17 = 0 THEN 5 WHEN frame_id % 19 = 0 THEN NULL ELSE hands END AS hands, manip FROM k)"


@query("response_violations", sql(f"WITH {_KINDS}, {_SPOILT} SELECT judge, rule, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT judge, '{name}' AS rule FROM s WHERE {rule}" for name, rule in _BROKEN.items()) + ") GROUP BY 1, 2"))
def response_violations(spark, d):
    f = F.col("frame_id")
    spoilt = _with_kinds(responses(spark, d)).select(
        "judge", "confidence", F.lit("P0").alias("prompt_variant"), F.when(f % 13 == 0, "lost").otherwise(F.col("status")).alias("status"),
        F.when(f % 17 == 0, 5).when(f % 19 == 0, None).otherwise(F.col("hands")).alias("hands_visible"), F.col("manip").alias("manipulation"),
    )
    return spoilt.select("judge", F.explode(schemas.response_violations()).alias("rule")).groupBy("judge", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("frame_violations", "SELECT rule, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'no reason for missing provenance' WHEN 1 THEN 'some provenance missing' WHEN 2 THEN 'reason with provenance' END AS rule FROM documents) WHERE rule IS NOT NULL GROUP BY 1")
def frame_violations(spark, d):
    kind = F.col("frame_id") % 4
    full = F.when(kind != 0, F.lit("x"))
    rows = _ids(spark, d).select(kind.alias("kind"), *[full.alias(c) for c in schemas.PROVENANCE[1:]], F.when(kind > 1, "x").alias("factory_id"), F.when(kind == 2, "no sidecar").alias("why_no_provenance"))
    return rows.select(F.explode(schemas.frame_violations()).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("label_violations", "SELECT rule, count(*) AS n FROM (SELECT 'unknown pass' AS rule FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT 'hands outside 0 to 2' FROM labels WHERE quality + toxic + 1 > 2 UNION ALL SELECT 'unknown tag' FROM labels WHERE doc_id % 5 = 0) GROUP BY 1")
def label_violations(spark, d):
    rows = gold(spark, d).select(
        F.when(F.col("frame_id") % 3 == 0, "third").otherwise("primary").alias("pass"), F.lit("easy").alias("difficulty"), (F.col("gold_hands") + 1).alias("hands_visible"), F.col("gold_manip").alias("manipulation"),
        F.when(F.col("frame_id") % 5 == 0, F.array(F.lit("blur"), F.lit("smoke"))).otherwise(F.array(F.lit("blur"))).alias("edge_case"),
    )
    return rows.select(F.explode(schemas.label_violations(("blur", "glove"))).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("forest_rows", sql("SELECT corpus AS label, 'published' AS kind, round(avg(gold_manip::INT), 6) AS value, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM pairs WHERE judge = 'A' GROUP BY 1 UNION ALL SELECT corpus, 'judge alone', round(avg(manip::INT), 6), NULL, NULL FROM ok_pairs WHERE judge = 'A' GROUP BY 1"))
def forest_rows(spark, d):
    labels = gold(spark, d)
    pairs = labels.join(responses(spark, d, labels), "frame_id").where("judge = 'A'")
    rate = lambda x, c: x.groupBy(F.col("corpus").alias("label")).agg(F.round(F.avg(F.col(c).cast("int")), 6).alias("value"))
    published = rate(pairs, "gold_manip").withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0)})
    alone = rate(pairs.where("status = 'ok'"), "manip")
    return report.forest(published, alone.where("false"), alone, alone.where("false"))


@query("evaluation_scan", "SELECT 'doc-sha256:' || sha256(text) AS frame_id, count(*) AS n FROM documents WHERE doc_id % 11 <> 0 AND length(text) > 0 GROUP BY 1")
def evaluation_scan(spark, d):
    path = shared_folder(spark, "evaluation")
    image = F.struct(F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("text")).cast("binary").alias("bytes"), F.lit("x").alias("path"))
    _docs(spark, d).select(image.alias("image"), "lang").write.parquet(path)
    return readers.evaluation_frames(spark, path, "doc-sha256:").groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


@query("published_labels", "SELECT doc_id AS frame_id, (quality + toxic)::INT AS hand_count, quality = 1 AS active_labor FROM labels JOIN documents USING (doc_id) WHERE lang = 'en'")
def published_labels(spark, d):
    path = shared_folder(spark, "vendor")
    gold(spark, d).select("frame_id", F.col("gold_hands").cast("int").alias("hand_count"), F.when(F.col("gold_manip"), "Yes").otherwise("no").alias("active_labor"), F.lit("x").alias("note")).write.parquet(path)
    return readers.published_labels(spark, path, _ids(spark, d).where("corpus = 'en'"))


@query("bytes_lookup", "SELECT doc_id AS frame_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE lang END) AS sha256 FROM documents JOIN labels USING (doc_id)")
def bytes_lookup(spark, d):
    f = frames(spark, d)
    image = lambda c: F.struct(F.col(c).cast("binary").alias("bytes")).alias("image")
    found = readers.lookup_bytes([f.where("frame_id % 2 = 0").select("frame_id", image("text")), f.select("frame_id", image("corpus"))], _label_ids(spark, d))
    return found.select("frame_id", F.sha2("bytes", 256).alias("sha256"))


@query("unpinned_revisions", "SELECT DISTINCT lang AS corpus, source AS corpus_rev FROM documents EXCEPT SELECT lang, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def unpinned_revisions(spark, d):
    revisions = _ids(spark, d).withColumnRenamed("cluster", "corpus_rev")
    return readers.unpinned_revisions(revisions, revisions.join(_label_ids(spark, d, "toxic = 1"), "frame_id").select("corpus", "corpus_rev").distinct())


@query("markdown_figures", "SELECT n_name AS name, n_nationkey::VARCHAR AS key, n_regionkey::VARCHAR AS region FROM nation")
def markdown_figures(spark, d):
    path = shared_folder(spark, "markdown")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "n_name", "n_nationkey", "n_regionkey"), F.lit(" |"))
    head = spark.createDataFrame([("# Nations",), ("",), ("| name | key | region |",), ("|---|---|---|",), ("| too | few |",)], "value string")
    head.unionByName(table(spark, d, "nation").select(row.alias("value"))).write.text(path)
    return readers.markdown_table(spark, path, ["name", "key", "region"])


@query("membership_store", "SELECT lang AS sample, count(*) AS n FROM documents WHERE lang <> 'en' OR n_chars > 500 GROUP BY 1")
def membership_store(spark, d):
    path = shared_folder(spark, "membership")
    members = _docs(spark, d).select(F.col("doc_id").alias("frame_id"), "n_chars", F.col("lang").alias("sample"))
    sinks.write_membership(members, path)
    sinks.write_membership(members.where("sample = 'en' and n_chars > 500"), path)
    return spark.read.parquet(path).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))


@query("label_store", "SELECT CASE WHEN toxic = 1 THEN 'review' ELSE 'primary' END AS \"pass\", count(*) AS n FROM labels GROUP BY 1")
def label_store(spark, d):
    path = shared_folder(spark, "labels")
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("frame_id"), F.lit("r1").alias("rater"), F.when(F.col("toxic") == 1, "review").otherwise("primary").alias("pass"))
    rows.where("pass = 'primary'").write.parquet(path)
    sinks.write_labels(spark.read.parquet(path), rows.where("pass = 'review'"), path)
    return spark.read.parquet(path).groupBy("pass").agg(F.count(F.lit(1)).alias("n"))


@query("dataset_export", sql("SELECT judge, status, count(*) AS n, sum(hands)::BIGINT AS hands FROM responses GROUP BY 1, 2"))
def dataset_export(spark, d):
    path = shared_folder(spark, "export")
    rows = responses(spark, d).select(F.col("frame_id").cast("string").alias("frame_id"), "judge", "status", F.col("hands").alias("hands_visible"), F.col("manip").alias("manipulation"))
    sinks.export_dataset({"judged": rows, "labels": gold(spark, d)}, path)
    return readers.responses(spark, f"{path}/judged").groupBy("judge", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("hands_visible").alias("hands"))
