"""Queries of the stored row index, pinned figures, closed records, retries, and slices at every level."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import records, schemas
from assayer.operators import frames as FR
from assayer.operators import judging, prose
from assayer.operators.agreement import all_slices
from assayer.plans.standins import all_pairs, frames, sql, table
from assayer.sources import corpus, row_index
from assayer.sources.shared import shared_folder

Q, SQL = {}, {}


def query(name: str, oracle: str):
    def add(f):
        Q[name], SQL[name] = f, oracle
        return f

    return add


@query("indexed_lookup", "SELECT doc_id AS frame_id, sha256(text) AS sha256, n_chars FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def indexed_lookup(spark, d):
    """The texts of the toxic documents through an index of rows, from files that other columns fill."""
    data, index = shared_folder(spark, "arm"), shared_folder(spark, "row-index")
    table(spark, d, "documents").withColumn("source_dataset", F.lit("arm")).repartitionByRange(12, "doc_id").write.parquet(data)
    row_index.build_index(spark, data, index, "doc_id", ("source_dataset", "arm"))
    wanted = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return row_index.lookup(spark, data, index, wanted, "doc_id", ["text", "n_chars"]).select(F.col("doc_id").alias("frame_id"), F.sha2("text", 256).alias("sha256"), "n_chars")


_PAGES = """
n AS (SELECT n_regionkey || '.md' AS document, n_name, n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation),
r AS (SELECT document, i, '| ' || n_name || ' | **' || n_nationkey || '** | ' || n_regionkey || ' |' AS line, n_name, n_nationkey, n_regionkey FROM n),
p AS (SELECT *, strlen('# Nationen über alles' || chr(10) || chr(10) || '| name | key | region |' || chr(10) || '|---|---:|---|' || chr(10)) + coalesce(sum(strlen(line) + 1) OVER (PARTITION BY document ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM r),
c AS (SELECT document, i + 4 AS line_number, n_nationkey::VARCHAR AS cell, spot + strlen('| ' || n_name || ' | **') AS start FROM p
  UNION ALL SELECT document, i + 4, n_regionkey::VARCHAR, spot + strlen('| ' || n_name || ' | **' || n_nationkey || '** | ') FROM p),
g AS (SELECT *, row_number() OVER (ORDER BY quality, toxic) AS i FROM (SELECT quality, toxic, count(*) AS k FROM labels GROUP BY ALL)),
h AS (SELECT i, k, toxic, '| q' || quality || ' | t' || toxic || ' | ' || format('{:,}', k) || ' |' AS line FROM g),
l AS (SELECT 'labels.md' AS document, i AS line_number, format('{:,}', k) AS cell, strlen('| q0 | t0 | ') + coalesce(sum(strlen(line) + 1) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, toxic FROM h)
"""


def _pages(spark, d):
    """document, text: the nations of each region and the counts of labels as tables."""
    row = F.concat(F.lit("| "), "n_name", F.lit(" | **"), F.col("n_nationkey"), F.lit("** | "), F.col("n_regionkey"), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", row.alias("row")))), lambda x: x["row"]), "\n")
    nations = table(spark, d, "nation").groupBy(F.concat(F.col("n_regionkey").cast("string"), F.lit(".md")).alias("document")).agg(F.concat(F.lit("# Nationen über alles\n\n| name | key | region |\n|---|---:|---|\n"), body).alias("text"))
    row = F.format_string("| q%d | t%d | %,d |", "quality", "toxic", "k")
    counts = table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("k"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("quality", "toxic", row.alias("row")))), lambda x: x["row"]), "\n")
    return nations.unionByName(counts.agg(F.lit("labels.md").alias("document"), body.alias("text"))), counts


@query("unpinned_figures", f"""WITH {_PAGES}
SELECT document, line_number::BIGINT AS line_number, cell, start::BIGINT AS start FROM c WHERE cell <> '4' AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 3 <> 0 AND n_regionkey || '.md' = document AND n_nationkey::VARCHAR = cell)
UNION ALL SELECT document, line_number, cell, start FROM l WHERE cell <> '4' AND cell NOT IN (SELECT cell FROM l WHERE toxic = 1)""")
def unpinned_figures(spark, d):
    """Cells of tables made of nation and labels that no pin stands for; figures reading 4 are exempt."""
    pages, counts = _pages(spark, d)
    pins = table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.col("n_regionkey").cast("string"), F.lit(".md")).alias("document"), F.col("n_nationkey").cast("string").alias("literal"))
    pins = pins.unionByName(counts.where("toxic = 1").select(F.lit("labels.md").alias("document"), F.format_string("%,d", "k").alias("literal")))
    return prose.unpinned_cells(pages, pins, ("4",)).select("document", F.col("line_number").cast("long").alias("line_number"), "cell", "start")


_FORMS = {"pct1": "{:.1f}", "pct2": "{:.2f}", "ratio2": "{:.2f}", "ratio3": "{:.3f}", "ratio4": "{:.4f}", "pp1": "{:.1f}", "pp2": "{:.2f}", "usd2": "{:.2f}", "int_comma": "{:,}", "raw_int": "{}"}


@query("printed_forms", f"WITH v AS (SELECT lang, sum(n_chars) AS k, round(avg((n_chars > 1000)::INT), 6) AS r FROM documents GROUP BY 1) SELECT lang, {', '.join(f'''format('{how}', {"k" if "int" in form else "r * 100" if form.startswith("pct") else "r"}{"::BIGINT" if "int" in form else ""}) AS {form}''' for form, how in _FORMS.items())} FROM v")
def printed_forms(spark, d):
    """The ten ways in which a figure is printed, from JSON documents by pointer."""
    v = table(spark, d, "documents").groupBy("lang").agg(F.sum("n_chars").alias("k"), F.round(F.avg((F.col("n_chars") > 1000).cast("double")), 6).alias("r"))
    v = v.select("lang", F.to_json(F.struct(F.array(F.struct("k", "r")).alias("by"))).alias("document"))
    return v.select("lang", *[FR.figure(F.col("document"), f"by.0.{'k' if 'int' in form else 'r'}", form).alias(form) for form in _FORMS])


_RAW = """raw_ AS (SELECT doc_id, '{"frame_id":' || CASE WHEN doc_id % 11 = 0 THEN '7' ELSE '"' || doc_id || '"' END || ',"judge":"A","judge_rev":"1","prompt_variant":"P0"' || CASE WHEN doc_id % 13 = 0 THEN '' ELSE ',"hands_visible":' || CASE WHEN doc_id % 5 = 0 THEN '1.5' WHEN doc_id % 5 = 1 THEN 'null' ELSE '2' END END
  || ',"manipulation":' || CASE WHEN doc_id % 17 = 0 THEN '"yes"' ELSE 'true' END || ',"confidence":' || CASE WHEN doc_id % 7 = 0 THEN '{"kind":"none","value":null,"why":1}' WHEN doc_id % 7 = 1 THEN '"none"' WHEN doc_id % 7 = 2 THEN '{"kind":"logprob"}' ELSE '{"kind":"logprob","value":0.5}' END
  || ',"raw":"x","status":"ok","latency_ms":' || n_chars || ',"cost_usd":0' || CASE WHEN doc_id % 9 = 0 THEN ',"extra":[1],"also":{}' ELSE '' END || CASE WHEN doc_id % 19 = 0 THEN '' ELSE '}' END AS raw FROM documents)"""


@query("rejected_records", f"""WITH {_RAW},
j AS (SELECT doc_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM raw_),
f(name, kinds) AS (VALUES ('frame_id', ['VARCHAR']), ('judge', ['VARCHAR']), ('judge_rev', ['VARCHAR']), ('prompt_variant', ['VARCHAR']), ('hands_visible', ['UBIGINT', 'BIGINT']), ('manipulation', ['BOOLEAN']), ('confidence', ['OBJECT']), ('raw', ['VARCHAR']), ('status', ['VARCHAR']), ('latency_ms', ['UBIGINT', 'BIGINT']), ('cost_usd', ['UBIGINT', 'BIGINT', 'DOUBLE'])),
k AS (SELECT doc_id, unnest(json_keys(j)) AS name FROM j WHERE j IS NOT NULL),
q AS (SELECT doc_id, json_extract(j, '$.confidence') AS c FROM j WHERE json_type(j, '$.confidence') = 'OBJECT'),
i AS (SELECT doc_id, unnest(json_keys(c)) AS name FROM q)
SELECT doc_id, '$' AS path, 'malformed' AS reason FROM j WHERE j IS NULL
UNION ALL SELECT doc_id, '$.' || name, 'unknown field' FROM k WHERE name NOT IN (SELECT name FROM f)
UNION ALL SELECT doc_id, '$.' || name, 'missing field' FROM j, f WHERE j IS NOT NULL AND NOT list_contains(json_keys(j), name)
UNION ALL SELECT doc_id, '$.' || name, 'wrong type' FROM j, f WHERE j IS NOT NULL AND json_type(j, '$.' || name) NOT IN ('NULL') AND NOT list_contains(kinds, json_type(j, '$.' || name))
UNION ALL SELECT doc_id, '$.confidence.' || name, 'unknown field' FROM i WHERE name NOT IN ('kind', 'value')
UNION ALL SELECT doc_id, '$.confidence.' || name, 'missing field' FROM q, (VALUES ('kind'), ('value')) t(name) WHERE NOT list_contains(json_keys(c), name)""")
def rejected_records(spark, d):
    """Every fault of response records some of which have unknown, missing or mistyped fields or are cut off."""
    i = lambda m, r=0: F.col("doc_id") % m == r
    raw = F.concat(
        F.lit('{"frame_id":'), F.when(i(11), "7").otherwise(F.concat(F.lit('"'), F.col("doc_id"), F.lit('"'))), F.lit(',"judge":"A","judge_rev":"1","prompt_variant":"P0"'),
        F.when(i(13), "").otherwise(F.concat(F.lit(',"hands_visible":'), F.when(i(5), "1.5").when(i(5, 1), "null").otherwise("2"))), F.lit(',"manipulation":'), F.when(i(17), '"yes"').otherwise("true"),
        F.lit(',"confidence":'), F.when(i(7), '{"kind":"none","value":null,"why":1}').when(i(7, 1), '"none"').when(i(7, 2), '{"kind":"logprob"}').otherwise('{"kind":"logprob","value":0.5}'),
        F.lit(',"raw":"x","status":"ok","latency_ms":'), F.col("n_chars"), F.lit(',"cost_usd":0'), F.when(i(9), ',"extra":[1],"also":{}').otherwise(""), F.when(i(19), "").otherwise("}"),
    )
    return records.rejected(table(spark, d, "documents").select("doc_id", raw.alias("raw")), "raw", schemas.RESPONSE, "doc_id")


class _Flaky:
    """Fails frame_id % 7 times in passing; one frame in 13 is refused for good."""

    def __init__(self):
        self.failed: dict[int, int] = {}

    def __call__(self, frame: int, text: str) -> dict:
        if frame % 13 == 0:
            raise ValueError("bad request")
        self.failed[frame] = self.failed.get(frame, 0) + 1
        if self.failed[frame] <= frame % 7:
            raise judging.TransientError("rate limit")
        return {"hands_visible": frame % 3, "manipulation": len(text) % 2 == 0, "raw": str(frame % 3)}


@query("judge_retries", """WITH d AS (SELECT doc_id, text, doc_id % 13 = 0 AS bad, doc_id % 7 > 4 AS lost, least(doc_id % 7, 4) AS fails FROM documents)
SELECT doc_id AS frame_id, CASE WHEN bad THEN 'error' WHEN lost THEN 'timeout' ELSE 'ok' END AS status, CASE WHEN NOT bad AND NOT lost THEN (doc_id % 3)::INT END AS hands_visible, CASE WHEN NOT bad AND NOT lost THEN length(text) % 2 = 0 END AS manipulation,
CASE WHEN bad THEN 'ValueError: bad request' WHEN lost THEN 'TransientError: rate limit' ELSE (doc_id % 3)::VARCHAR END AS raw, CASE WHEN bad THEN 1 ELSE fails + 1 END::INT AS attempts,
CASE WHEN bad THEN 0 ELSE [0, 0.001, 0.003, 0.006, 0.009][fails + 1] END::DOUBLE AS waited_s FROM d""")
def judge_retries(spark, d):
    """A judge that fails in passing, for good, or too often: attempts and waiting times of each answer."""
    f = frames(spark, d).select("frame_id", "text")
    got = judging.judge_with_retries(f, "J", "1", "P0", _Flaky(), "text", judging.Retry(4, 0.001, 0.003), workers=4)
    return got.select("frame_id", "status", "hands_visible", "manipulation", "raw", "attempts", F.round("waited_s", 6).alias("waited_s"))


_SLICES = """t AS (SELECT corpus, judge, unnest(['hands', 'manipulation']) AS task, unnest([hands >= 1, manip]) AS said, unnest([gold_hands >= 1, gold_manip]) AS truth FROM ok_pairs)"""


@query("all_slices_confusion", sql(f"""WITH {_SLICES} SELECT corpus, judge, task, grouping_id(corpus, judge, task)::BIGINT AS level, count(*) AS n, count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp,
count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn, round(avg((said = truth)::INT), 6) AS accuracy FROM t WHERE said IS NOT NULL AND truth IS NOT NULL GROUP BY CUBE (corpus, judge, task)"""))
def all_slices_confusion(spark, d):
    """Confusion counts of every corpus, judge and task, of each two and one of them and of all, in one aggregation."""
    pairs = all_pairs(spark, d).where("status = 'ok'")
    tasks = F.array(F.struct(F.lit("hands").alias("task"), (F.col("hands") >= 1).alias("said"), (F.col("gold_hands") >= 1).alias("truth")), F.struct(F.lit("manipulation").alias("task"), F.col("manip").alias("said"), F.col("gold_manip").alias("truth")))
    rows = pairs.select("corpus", "judge", F.inline(tasks))
    return all_slices(rows, "said", "truth", "corpus", "judge", "task").withColumn("accuracy", F.round("accuracy", 6))


_SHARDS = """x AS (SELECT source || '.tar' AS shard, lpad(doc_id::VARCHAR, 9, '0') AS stem, doc_id, lang, n_chars, strlen(text) AS size, doc_id % 7 <> 0 AS paired FROM documents),
y AS (SELECT *, CASE WHEN paired THEN strlen('{"factory_id":"' || lang || '","duration_sec":' || n_chars || '}') END AS side FROM x),
z AS (SELECT *, 512 + (size + 511) // 512 * 512 + CASE WHEN paired THEN 512 + (side + 511) // 512 * 512 ELSE 0 END AS room FROM y),
s AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY shard ORDER BY stem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM z)"""


def _corpus(spark, d):
    """The folder of a corpus with a tar for each source of the documents, texts as clips; every seventh has no sidecar."""
    folder = shared_folder(spark, "corpus")
    side = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit('{"factory_id":"'), "lang", F.lit('","duration_sec":'), F.col("n_chars"), F.lit("}")))
    rows = table(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("stem"), F.col("text").cast("binary").alias("payload"), side.alias("sidecar"))
    corpus.write_shards(rows, folder, "source", "stem", "payload", "sidecar")
    return folder


@query("corpus_manifest", f"WITH {_SHARDS} SELECT shard, stem AS clip_id, lang AS factory_id, n_chars::DOUBLE AS duration_sec, (base + 512)::BIGINT AS mp4_offset, size AS mp4_size FROM s WHERE paired")
def corpus_manifest(spark, d):
    """The manifest of the documents' shards, from headers and sidecars alone, by two runs of which the second goes on."""
    folder, path = _corpus(spark, d), shared_folder(spark, "manifest")
    corpus.extend_manifest(spark, folder, path, limit=3)
    corpus.extend_manifest(spark, folder, path)
    return corpus.known_manifest(spark, path).select("shard", "clip_id", "factory_id", "duration_sec", "mp4_offset", "mp4_size")


@query("shard_contents", f"WITH {_SHARDS}, m AS (SELECT shard, 'mp4' AS ext, size FROM s UNION ALL SELECT shard, 'json', side FROM s WHERE paired) SELECT shard, ext, count(*) AS n, sum(size)::BIGINT AS bytes FROM m GROUP BY 1, 2")
def shard_contents(spark, d):
    """Members and bytes of each shard by extension, through the source of tar headers."""
    from assayer.sources.tar import TarMembers, extension_histogram

    paths = [r["path"] for r in corpus.list_shards(spark, _corpus(spark, d)).select("path").collect()]
    spark.dataSource.register(TarMembers)
    found = spark.read.format("tar_members").option("paths", ",".join(paths)).load()
    return extension_histogram(found, "shard")
