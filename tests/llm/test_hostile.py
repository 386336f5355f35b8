"""Tables that once crashed or misled an operator: ASCII only, all null, all blank, single-use words, no queries, words that trick polynomial hashes."""

import hashlib

import pytest
from brute import components, top_k
from pyspark.sql import functions as F

from assayer.llm import bpe, near_dups, toxicity
from assayer.llm import top_k as search
from assayer.llm.queries import held_out, vocabulary_path
from assayer.llm.tables import shared_folder

TABLE = "doc_id long, text string"


def thue_morse(n):
    a = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def toxic_labels(spark, n):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("texts", [["plain words of an english text"] * 8, [None] * 5, ["", "  "] * 3, ["you idiot %d" % i for i in range(20)]], ids=["ascii", "null", "blank", "toxic"])
def test_toxicity_of_ascii(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), TABLE)
    clf = toxicity.train_classifier(docs, toxic_labels(spark, len(texts)), ~held_out("_id"))
    rows = toxicity.score_documents(docs, clf).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


@pytest.mark.parametrize("shard", [12 << 20, 600])
@pytest.mark.parametrize("kind", ["single", "none asked", "blank asked", "all blank"])
def test_top_k_without_common_terms(spark, kind, shard, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", shard)
    rows = [(i, f"w{i} v{i} w{i // 2}") for i in range(100)]
    rows = [(i, " ") for i, _ in rows] if kind == "all blank" else [(i, None if i % 50 == 0 else t) for i, t in rows] if kind == "blank asked" else rows
    asked = F.lit(False) if kind == "none asked" else F.col("doc_id") % 50 == 0
    got = search.top_k(spark.createDataFrame(rows, TABLE), asked).collect()
    want = {} if kind == "none asked" else top_k(rows, lambda i: i % 50 == 0, 10)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == sorted((q, n, i) for q, found in want.items() for n, (_, i) in enumerate(found, 1))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_trick_a_polynomial(spark, n):
    from tokenizers import Tokenizer

    rows = list(enumerate(thue_morse(n), 1))
    docs = spark.createDataFrame(rows, TABLE).coalesce(1)
    library = Tokenizer.from_file(vocabulary_path())
    want = {i: hashlib.sha256(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t in rows}
    assert {r.doc_id: r.ids_sha256 for r in bpe.token_digests(docs, vocabulary_path()).collect()} == want
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()} == components(rows)[0]


def test_only_local_mode_falls_back_to_a_local_folder():
    class Session:
        def __init__(self, **conf):
            self.values, self.conf = {k.replace("_", "."): v for k, v in conf.items()}, self

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    assert shared_folder(Session(spark_checkpoint_dir="hdfs://x", spark_master="yarn")) == "hdfs://x"
    local = Session(spark_master="local[2]")
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master="yarn"))


def test_scorer_finds_what_the_reader_finds(spark):
    import numpy as np
    import pyarrow as pa

    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    odd = [None, "", "a", "ab", "abc!", "abcd.", "ABBBa fuuuck Idiot, idi0t! !idiot (idiot) idiot) 'idiot' i.d.i.o.t idiot.. idio", "aaa AaA aab ab.", "é éé ééé Ééé aéÉéa ÀÀÀ ×××a a×b ÷ ßßß ñandú. über! Ōk ÿÿÿ idiöt 中文 😀a ababab éaéaéa idiÉÉÉ", "x" * 500 + " idiot", "id\u0131ot IDIOT? idiotic"]
    model = toxicity.CharModel(np.ones(toxicity.SYMBOLS**3))
    weights = {"=idiot": 2.0, "idi": 0.5, "idiot": 1.5, "=ab": 1.0, "que": 0.3, "=the": 0.1, "the": 0.2}
    texts = [*odd, *docs]
    scorer, reader = toxicity.Scorer(toxicity.Reader(model, weights)), toxicity.Reader(model, weights)
    got = [f for part in toxicity.K.blocks(toxicity.K.buffers(pa.array(texts, pa.string())), 20_000) for f in scorer.texts(part)]
    assert got == [reader.text((t or "").encode()) for t in texts] and sum(map(bool, got)) > 20
