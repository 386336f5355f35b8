"""URL filter: a trie over reversed host labels, then path segments, broadcast to the executors.

An entry (host, path) fits its host and every subdomain when the URL's path
starts with the entry's path. The entry with the longest host wins, then the
one with the longest path; of an allow and a block entry for the same host and
path the block entry wins. A URL that no entry fits gets the default verdict.

Defined results: a null URL or one without "://" has an empty host and path and
gets the default; nulls in entries are rejected; repeated entries collapse; an
empty page table gives an empty result; other columns of the pages pass by.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many entries are broadcast as a trie; more are joined as a table.
MAX_BROADCAST_RULES = 2_000_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def label(self) -> str:
        return f"{self.host}{self.path}"


class Trie:
    """Host labels from the right; below a host that has entries, its paths by segments. The last segment of an entry's path is a
    prefix of the URL's: a node keeps these by length, longest first."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for r in rules:
            _check(r)
            node = self.root
            for label in reversed(r.host.lower().split(".")):
                node = node.setdefault(label, {})
            *whole, last = r.path.split("/")
            segment = node.setdefault(None, ({}, {}))
            for name in whole:
                segment = segment[0].setdefault(name, ({}, {}))
            ends = segment[1].setdefault(len(last), {})
            if last not in ends or r.verdict == "block":
                ends[last] = r

    def find(self, host: str, path: str) -> Rule | None:
        best, node, names = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get(None)
            found = None
            for name in names:
                if below is None:
                    break
                for size in sorted(below[1], reverse=True):
                    if rule := below[1][size].get(name[:size]) if size <= len(name) else None:
                        found = rule
                        break
                below = below[0].get(name)
            best = found or best
        return best


def _check(r: Rule) -> None:
    if r.host is None or r.path is None or r.verdict not in ("allow", "block"):
        raise ValueError(f"not a URL rule: {r}")


def split_url(url: str = "url") -> list:
    """Spark columns (host, path), parsed on the JVM."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.expr(f"substring(coalesce(`{url}`, ''), locate('://', coalesce(`{url}`, '')) + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return [host.alias("host"), path.alias("path")]


def judge_urls(pages: DataFrame, rules: Iterable[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: key, host, path, rule (null if none fits), verdict."""
    rules = list(rules)
    if len(rules) > MAX_BROADCAST_RULES:
        for r in rules:
            _check(r)
        return join_verdicts(pages, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), key, url, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    parsed = pages.select(F.col(key), *split_url(url))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in batches:
            found = [find(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([r and r.label for r in found], pa.string()), pa.array([r.verdict if r else default for r in found], pa.string())],
                names=[key, "host", "path", "rule", "verdict"],
            )

    kind = parsed.schema[key].dataType.simpleString()
    return parsed.mapInArrow(walk, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def join_verdicts(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """judge_urls for a table of entries (verdict, host, path) of any size. Pages are joined by each suffix of their host with
    the lengths of that host's paths, then by host and prefix with the entries."""
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    single = rules.groupBy(lower.alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("verdict"), F.min_by("host", "verdict").alias("as_written"))
    sizes = single.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("sizes"))
    parsed = pages.select(F.col(key), *split_url(url))
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = parsed.select("host", "path").distinct()
    met = asked.withColumn("rule_host", F.explode(suffixes)).join(sizes, "rule_host").withColumn("n", F.explode("sizes")).where(F.col("n") <= F.length("path"))
    fits = met.withColumn("rule_path", F.substring("path", F.lit(1), F.col("n"))).join(single, ["rule_host", "rule_path"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule_host"), "n", "as_written", "rule_path", "verdict")).alias("best"))
    label = F.concat("best.as_written", "best.rule_path")
    return parsed.join(best, ["host", "path"], "left").select(key, "host", "path", label.alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The entries of the registered query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

ORACLE = r"""
WITH parsed AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), fit AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' END AS rule
  FROM parsed
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM fit
"""
