"""Collocations against plain Python counts, on the driver's tables and on hostile ones."""

import collections
import re

import pytest
from brute import SCHEMA, hostile

from assayer.llm import collocations as co

DATA = "/root/testdata/sf0.001"


def brute(rows, least=10, shortest=2, longest=3, covered=50, best=2000):
    f, words = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if shortest <= len(p) <= longest and a >= least}
        gone = {q[i : i + n] for q, b in found.items() for n in range(shortest, len(q)) for i in range(len(q) - n + 1) if 100 * b >= covered * c[q[i : i + n]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, _, l, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, b" ".join(p), l, r))
        out += [(lang, k, p.decode(), -a, l, r, words[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out)


def listed(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def pairs(table):
    return [(r.lang, r.text) for r in table.select("lang", "text").collect()]


@pytest.mark.parametrize("shard", [3 << 20, 4000])
def test_driver_tables(spark, shard, monkeypatch):
    monkeypatch.setattr(co, "SHARD_BYTES", shard)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = co.collocations(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert listed(got) == brute(pairs(docs)) and got.count() > 50
    assert listed(co.collocations(docs, least=3, best=7)) == brute(pairs(docs), least=3, best=7)
    assert listed(co.collocations(docs, least=4, shortest=2, longest=5)) == brute(pairs(docs), least=4, longest=5)


@pytest.mark.parametrize("cells", [1 << 16, 1 << 24])
def test_hostile_tables(spark, cells, monkeypatch):
    monkeypatch.setattr(co, "MAX_CELLS", cells)
    texts = [None, "", " \t ", "a b " * 40, "a a a a a a a a a a a a a a", "x.y" * 20, "New york, new york! new york" * 12, "\0 nul \0 nul " * 9, "ümläut wörd " * 11, "z\x1cz z\x1cz " * 8, "c d e " * 30 + ". c d " * 40, "tie one tie two " * 10]
    rows = [(i, t, None if i % 3 == 0 else "en", None, None, "clash", 0.5) for i, t in enumerate(texts * 2)]
    table = hostile(spark).unionByName(spark.createDataFrame(rows, SCHEMA))
    assert listed(co.collocations(table)) == brute(pairs(table))
    assert listed(co.collocations(table, least=2)) == brute(pairs(table), least=2)


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    cur = con.execute(co.ORACLE)
    got = co.collocations(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert [d[0] for d in cur.description] == got.columns and sorted(cur.fetchall()) == listed(got)


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counts_past_64_bits(spark):
    a = spark.sql("SELECT 3000000000 AS a, 3000000001 AS l, 4000000000 AS r")
    assert a.selectExpr(f"{co.SCORE} AS s").first()["s"] == 1000000 * 3000000000**2 // (3000000001 * 4000000000)
