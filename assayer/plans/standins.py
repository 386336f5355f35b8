"""The audit's inputs, made from the driver's tables by deterministic rules.

Documents are frames (lang the corpus, source the cluster), labels the human
labels, and three text rules the automatic judges; a few answers are refused,
time out or cannot be parsed by the document's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JUDGES = ("A", "B", "C")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), F.col("lang").alias("corpus"), F.col("source").alias("cluster"), "text", "n_chars")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, hands (0 to 2), manip."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("frame_id"), (F.col("quality") + F.col("toxic")).alias("gold_hands"), (F.col("quality") == 1).alias("gold_manip"))


def responses(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """frame_id, corpus, cluster, judge, status, manip, hands, conf: one row a frame (of those in `of`) and judge; answers null unless ok."""
    text, letters, stops, bang = F.col("text"), F.col("f.letters"), F.col("f.stops"), F.col("f.bang")
    answer = {"A": letters > 0.9, "B": ~bang, "C": stops >= 5}
    status = lambda i: F.when(F.col("frame_id") % 23 == i, "refused").when(F.col("frame_id") % 29 == i, "timeout").when(F.col("frame_id") % 31 == i, "unparseable").otherwise("ok")
    hands = {"A": F.when(letters > 0.97, 2).when(letters > 0.9, 1).otherwise(0), "B": F.when(bang, 0).otherwise(F.when(stops >= 20, 2).otherwise(1)), "C": F.least(F.lit(2), F.floor(stops / 10).cast("int"))}
    rows = F.array(*[F.struct(F.lit(j).alias("judge"), status(i).alias("status"), answer[j].alias("manip"), hands[j].cast("int").alias("hands"), (F.pmod(F.col("frame_id") * (7 + i), F.lit(100)) / 100.0).alias("conf")) for i, j in enumerate(JUDGES)])
    # What the rules look at is computed once a text: a generator stands between it and its many uses. Letters are counted by
    # taking out their runs: taking out all else, mark by mark, costs eight times as much. The share of an empty text is 0 / 0,
    # which lies above any bound, as in the SQL; Spark's own division raises there.
    letters_in = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-zÀ-ÿ ]+", ""))
    share = F.when(F.length(text) == 0, float("nan")).otherwise(letters_in / F.length(text))
    features = F.struct(share.alias("letters"), (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))).alias("stops"), F.contains(text, F.lit("!")).alias("bang"))
    asked = frames(spark, sf_dir) if of is None else frames(spark, sf_dir).join(of.select("frame_id"), "frame_id", "left_semi")
    seen = asked.select("frame_id", "corpus", "cluster", F.explode(F.array(features)).alias("f"))
    flat = seen.select("frame_id", "corpus", "cluster", F.explode(rows).alias("r")).select("frame_id", "corpus", "cluster", "r.*")
    ok = F.col("status") == "ok"
    return flat.withColumns({"manip": F.when(ok, F.col("manip")), "hands": F.when(ok, F.col("hands"))})


#: The same rows in SQL: views frames, gold, responses.
BASE = r"""
frames AS (SELECT doc_id AS frame_id, lang AS corpus, source AS cluster, text, n_chars FROM documents),
gold AS (SELECT doc_id AS frame_id, quality + toxic AS gold_hands, quality = 1 AS gold_manip FROM labels),
features AS (
  SELECT frame_id, corpus, cluster, length(regexp_replace(text, '[^A-Za-zÀ-ÿ ]', '', 'g')) / length(text) AS letters,
    length(text) - length(replace(text, '.', '')) AS stops, contains(text, '!') AS bang FROM frames),
raw_responses AS (
  SELECT frame_id, corpus, cluster, 'A' AS judge, 0 AS i, letters > 0.9 AS m, CASE WHEN letters > 0.97 THEN 2 WHEN letters > 0.9 THEN 1 ELSE 0 END AS h FROM features
  UNION ALL SELECT frame_id, corpus, cluster, 'B', 1, NOT bang, CASE WHEN bang THEN 0 WHEN stops >= 20 THEN 2 ELSE 1 END FROM features
  UNION ALL SELECT frame_id, corpus, cluster, 'C', 2, stops >= 5, least(2, stops // 10) FROM features),
stated AS (
  SELECT *, CASE WHEN frame_id % 23 = i THEN 'refused' WHEN frame_id % 29 = i THEN 'timeout' WHEN frame_id % 31 = i THEN 'unparseable' ELSE 'ok' END AS status,
    (frame_id * (7 + i)) % 100 / 100.0::DOUBLE AS conf FROM raw_responses),
responses AS (SELECT frame_id, corpus, cluster, judge, status, CASE WHEN status = 'ok' THEN m END AS manip, CASE WHEN status = 'ok' THEN h END AS hands, conf FROM stated),
pairs AS (SELECT * FROM gold JOIN responses USING (frame_id)),
ok_pairs AS (SELECT * FROM pairs WHERE status = 'ok')
"""


def sql(body: str) -> str:
    """A query over the views above."""
    head, _, rest = body.strip().partition("WITH ")
    return f"WITH {BASE}, {rest}" if not head and rest else f"WITH {BASE} {body}"


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = gold(spark, sf_dir)
    return labels.join(responses(spark, sf_dir, labels), "frame_id")


def ok_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(spark, sf_dir).where("status = 'ok'")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, event_type, value, conf: the response log (status error for errors)."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("conf"))


EVENTS = "ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) / 100.0::DOUBLE AS conf FROM events)"
