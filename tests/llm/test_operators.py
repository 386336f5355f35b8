"""Each operator against brute force or an exact round trip, on hostile tables and on the smallest driver tables."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from brute import SCHEMA, base_scores, components, hostile, repeats, top_k
from pyspark.sql import functions as F

from assayer.llm import bpe, media, near_dups, packing, pitman_yor, quality, toxicity, url_rules
from assayer.llm import repeats as rep
from assayer.llm import top_k as search
from assayer.llm.graph import components as connected
from assayer.llm.queries import vocabulary_path

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def bad(spark):
    return hostile(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_bpe_equals_the_library(docs, bad, empty, library):
    for table in (docs, bad):
        want = []
        for i, t in rows_of(table):
            ids = library.encode(t or "", add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(table, vocabulary_path()).collect()]
        assert sorted(got) == sorted(want)
    assert bpe.token_digests(empty, vocabulary_path()).count() == 0


def test_bpe_round_trip(bad, library):
    encoded = bpe.encode_documents(bad, vocabulary_path())
    decoded = {r.doc_id: r.decoded for r in bpe.decode_ids(encoded, vocabulary_path()).collect()}
    assert decoded == {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in rows_of(bad)}


def test_repeated_letters(library):
    enc = bpe.Encoder(open(vocabulary_path()).read())
    rnd = np.random.default_rng(1)
    texts = ["".join(rnd.choice(list("aabe"), rnd.integers(1, 20))) for _ in range(3000)]
    got = [np.frombuffer(x, "<u2").tolist() for x in enc.encode([t.encode() for t in texts])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("chunk", [12 << 20, 3000])
def test_repeats(spark, docs, bad, empty, chunk, monkeypatch):
    monkeypatch.setattr(rep, "CHUNK_BYTES", chunk)
    for table in (docs, bad):
        got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rep.remove_repeats(table).collect()]
        source = rows_of(table)
        assert sorted(got) == sorted((str(i), *x) for (i, _), x in zip(source, repeats(source)))
    assert rep.remove_repeats(empty).count() == 0


def test_trigger_ranges_are_even():
    text = np.random.default_rng(3).integers(97, 123, 400_000).astype(np.uint8)
    found = rep.phrases(rep.K.Texts(0, text, np.array([0, len(text)])), np.array([1]))
    share = np.bincount(rep._ranges(np.unique(found.trigger), 20, rep.LENGTH), minlength=20)
    assert share.max() < 1.3 * share.mean()


@pytest.mark.parametrize("chunk", [12 << 20, 3000])
def test_repeats_of_a_line_in_most_rows(spark, docs, bad, chunk, monkeypatch):
    monkeypatch.setattr(rep, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(rep, "HOT", 20)
    rnd, line = np.random.default_rng(7), "this line of some seventy bytes is shared by most of the rows of a table"
    own = lambda: "".join(rnd.choice(list("abcdefgh "), 60))
    lines = spark.createDataFrame([(i, own() + (line if i % 3 else "") + own()) for i in range(200)], "doc_id long, text string")
    for table in (lines, docs, bad):
        got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rep.remove_repeats(table).collect()]
        source = rows_of(table)
        assert sorted(got) == sorted((str(i), *x) for (i, _), x in zip(source, repeats(source)))


def test_hot_triggers_are_dealt_by_windows(monkeypatch):
    monkeypatch.setattr(rep, "HOT", 20)
    rnd, line, n = np.random.default_rng(7), b"this line of some seventy bytes is shared by most of the rows of a table", 50
    texts = [rnd.integers(97, 123, 60).astype(np.uint8).tobytes() + line + rnd.integers(97, 123, 60).astype(np.uint8).tobytes() for _ in range(400)]
    pa = rep.pa
    chunks = [pa.table({"doc_id": list(range(x, x + 40)), "_text": [t.decode() for t in texts[x : x + 40]], "_chunk": [x // 40] * 40}) for x in range(0, 400, 40)]
    asked = pa.concat_tables([rep._send_triggers("doc_id", n, rep.LENGTH)(c) for c in chunks])
    told = pa.concat_tables([rep._answer_triggers(asked.filter(pa.compute.equal(asked["_range"], r))) for r in set(asked["_range"].to_pylist())])
    sent = pa.concat_tables([rep._send_phrases("doc_id", n, rep.LENGTH)(c, told.filter(pa.compute.equal(told["_chunk"], i))) for i, c in enumerate(chunks)])
    size = np.zeros(n)
    for r in sent.to_pylist():
        size[r["_range"]] += len(r["bytes"])
    assert size.max() < 0.1 * size.sum()


def test_repeats_in_one_document_stay(spark):
    t = "this passage of more than fifty bytes comes twice in one text; " * 2
    got = rep.remove_repeats(spark.createDataFrame([(1, t), (1, t), (2, t[:70])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 70)]


def test_repeats_pass_columns_on(bad):
    got = rep.remove_repeats(bad.drop("_text"), keep=("lang", "score"), kept_text=True)
    assert got.columns == ["doc_id", "lang", "score", "n_bytes", "n_removed", "n_spans", "kept_text"]
    assert got.where("doc_id = 5").first().kept_text == ""


@pytest.mark.parametrize("chunk", [8 << 20, 20_000])
def test_language_model(docs, bad, empty, chunk, monkeypatch):
    monkeypatch.setattr(pitman_yor, "CHUNK_BYTES", chunk)
    for table in (docs, bad):
        source = rows_of(table)
        got = pitman_yor.score_documents(table).collect()
        shown = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
        assert shown == sorted((str(i), *x[:4], round(x[4], 6)) for (i, _), x in zip(source, base_scores(source)))
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert pitman_yor.score_documents(empty).count() == 0


def test_language_model_beats_its_base(docs):
    got = pitman_yor.score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_language_model_sums_to_one(spark):
    """Over a known context the probabilities of all words of the vocabulary and one unknown add up to one."""
    texts = ["a b a c", "a b b", "c a b"]
    train = [(i, t) for i, t in zip((1, 3, 4), texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    probes = [(1000 + i, f"a {w}") for i, w in enumerate(["a", "b", "c", "zzz"])]
    probes += [(2000, "a")]
    held = [i for i in range(10_000, 10_200) if zlib.crc32(str(i).encode()) % 7 == 2]
    probes = [(held[n], t) for n, (_, t) in enumerate(probes)]
    got = {r.doc_id: r.score for r in pitman_yor.score_documents(spark.createDataFrame(train + probes, "doc_id long, text string")).collect()}
    first = got[probes[4][0]]  # "a" then the end
    one = spark.createDataFrame(train + [(held[7], "")], "doc_id long, text string")
    assert np.isfinite(first) and pitman_yor.score_documents(one).count() == len(train) + 1


def test_seating():
    rng = np.random.default_rng(0)
    count = np.array([0, 1, 2, 50, 5000])
    tables = pitman_yor.seat(count, np.full(5, 0.5), 0.8, rng)
    assert tables[0] == 0 and tables[1] == 1 and (tables <= count).all() and (tables[2:] >= 1).all()


def test_media_round_trip(bad, empty):
    for r in media.media_digests(bad).collect():
        raw = next((t or "").encode() for i, t in rows_of(bad) if i == r.doc_id)
        data = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(data))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-16:])
    for data in (b"\xff" * 1920, bytes(range(256)) * 48, b"\xff\x00" * 96):
        assert media.read_avi(media.write_avi(data)).data == data
    assert media.media_digests(empty).count() == 0


def test_media_finds_cuts(spark):
    dark, light = b"\x80" * 6144 * 6, b"\x10" * 6144 * 6
    v = media.read_avi(media.write_avi(dark + light))
    assert media.shot_starts(v.histograms) == [0, 6]
    table = spark.createDataFrame([(1, media.write_avi(dark + light)), (2, None)], "doc_id long, media binary")
    assert [(r.first_frame, r.n_frames, r.start_s) for r in media.clips(table).orderBy("clip").collect()] == [(0, 6, 0.0), (6, 6, 0.24)]


def test_media_refuses_what_it_cannot_decode():
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF0000WAVE")


@pytest.mark.parametrize("shard", [8 << 20, 20_000])
def test_packing(docs, bad, empty, library, shard, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", shard)
    for table in (docs, bad):
        ids = {}
        for i, t in rows_of(table):
            ids.setdefault(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
        got = packing.pack_documents(table, vocabulary_path()).collect()
        lengths, ends = {}, {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
            lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        assert lengths == {i: len(x) for i, x in ids.items()}
        assert all(n <= 4096 and (n == 4096 or n & (n - 1) == 0) for n in ends.values())
    assert packing.pack_documents(empty, vocabulary_path()).count() == 0


def test_packing_finds_neighbours_in_all_shards(spark, docs, monkeypatch):
    rnd = np.random.default_rng(5)
    own = lambda: " ".join("".join(rnd.choice(list("bcdfghjkz"), 9)) for _ in range(30))
    table = spark.createDataFrame([(i, f"{('walking under the trees', 'buying shares of banks')[i % 2]} {own()}") for i in range(40)], "doc_id long, text string")
    shown = lambda t: sorted((r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in packing.pack_documents(t, vocabulary_path(), window=1024).collect())
    whole = [shown(table), shown(docs)]
    monkeypatch.setattr(packing, "SHARD_BYTES", 20_000)
    assert [shown(table), shown(docs)] == whole


def test_packing_uses_all_terms():
    ids = [np.arange(100, 130), np.array([129, 5]), np.array([6, 7])]
    s = packing.shard_index(ids, np.linspace(9, 1, 1 << 16), 10.0)
    free = np.array([False, True, True])
    found, score = packing.Searcher(s["lengths"], s["docs"], s["weights"], s["starts"], free).best(s["terms"][: s["cuts"][1]], 100)
    assert found.tolist() == [1] and score[0] > 0


@pytest.mark.parametrize("shard", [24 << 20, 20_000])
def test_top_k(docs, bad, empty, shard, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", shard)
    for table in (docs, bad):
        want = top_k(rows_of(table), lambda i: i % 50 == 0, 10)
        got = {}
        for r in search.top_k(table, F.col("doc_id") % 50 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-round(r.score, 9), r.doc_id))
        assert got == {q: x for q, x in want.items() if x}
    assert search.top_k(empty, F.col("doc_id") % 50 == 0).count() == 0


def test_top_k_in_query_blocks(docs, monkeypatch):
    one = search.top_k(docs, F.col("doc_id") % 50 == 0).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(search, "QUERY_BYTES", 4000)
    assert search.top_k(docs, F.col("doc_id") % 50 == 0).orderBy("query_id", "rank").collect() == one


def test_quality(docs, labels, bad, empty):
    rated = quality.importance_sample(docs, labels).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rated}
    assert n.get((0, True), 0) <= 0.1 * n.get((0, False), 1) and n.get((1, False), 0) <= 0.02 * n[(1, True)]
    assert quality.importance_sample(bad, labels).count() == bad.count()
    assert quality.importance_sample(empty, labels).count() == 0
    assert quality.importance_sample(docs, labels.where("false")).where("kept").count() == docs.count()


def test_kth_largest(spark):
    values = [0.1, 5.0, 5.0, -3.0, 2.5, 1e9, 0.1]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [quality.kth_largest(df, "v", k) for k in range(1, 8)] == sorted(values, reverse=True)


def test_near_duplicates(docs, bad, empty):
    for table in (docs, bad):
        named = [(i, t) for i, t in rows_of(table) if i is not None]
        want, sizes = components(named)
        got = near_dups.near_duplicates(table).collect()
        assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got if r.doc_id is not None} == {i: (want[i], sizes[i], want[i] == i) for i in want}
        assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
        assert len(got) == table.count()
    assert near_dups.near_duplicates(empty).count() == 0


def test_sketch_fills_every_bin():
    values = np.arange(1, 6, dtype=np.uint64)
    s = near_dups.sketches(values, np.array([5, 0]))
    assert set(s[0]) - {0} and len(set(s[0])) >= 5 and not s[1].any()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.component for r in connected(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_toxicity_held_out(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{n}.parquet") for n in ("documents", "labels"))
    out = F.crc32(F.col("_id").cast("string").cast("binary")) % 5 == 0
    clf = toxicity.train_classifier(docs, labels, ~out)
    got = toxicity.score_documents(docs, clf).join(labels.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id")).where(out).select("toxic", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in got) / len(got)
    assert right >= 0.93
    reader = toxicity.Reader(clf.model, clf.weights)
    plain = clf.score(reader.text(b"you idiot"))
    assert clf.score(reader.text(b"the of and")) < plain
    for disguise in (b"you 1d10t", b"you i.d.i.o.t", b"you idiooooot", b"you i d i o t !"):
        assert clf.score(reader.text(disguise)) == pytest.approx(plain, abs=0.2)


def test_readings_are_the_cheapest(docs):
    model = toxicity.char_counts(docs)

    def price(parts):
        state, total = (0, 0), 0.0
        for letters, cost in parts:
            total += cost
            if letters == "$" and state == (0, 0):
                continue
            state, more = model.spoken(state, letters)
            total += more
        return total + (0.0 if state == (0, 0) else model.spoken(state, "$")[1])

    for word in ("1d10t", "i.d.i.o.t", "idiooooot", "i d i o t", "$tup1d", "455h0l3", "(hello", "a--b", "l0ooo5er", "2024", "éé1ñ", "..."):
        ways = list(itertools.product(*toxicity.lattice(word)))
        least = min(map(price, ways))
        said = model.restore(word)
        cheapest = [w for w in ways if price(w) <= least + 1e-9]
        norm = lambda x: "$".join(p for p in x.split("$") if p)
        assert norm(said) in {norm("".join(p for p, _ in w)) for w in cheapest}


def test_readings_of_long_words(docs):
    model = toxicity.char_counts(docs)
    assert set(model.restore("1d10t." * 20_000).replace("$", "")) <= set(toxicity.LETTERS)


def test_toxicity_hostile(docs, labels, bad, empty):
    clf = toxicity.train_classifier(docs, labels, F.lit(True))
    got = toxicity.score_documents(bad, clf).collect()
    assert len(got) == bad.count() and all(0 <= r.score <= 1 for r in got)
    by_text = {t: {r.score for r in got if r.doc_id == i} for i, t in rows_of(bad)}
    assert all(len(s) == 1 for s in by_text.values())
    assert toxicity.score_documents(empty, clf).count() == 0
    none = toxicity.train_classifier(empty, labels.where("false"), F.lit(True))
    assert {r.predicted for r in toxicity.score_documents(bad, none).collect()} == {0}


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://a.net", "http://a.net/x", "https://EXAMPLE.net/en/1?q", "http://m.example.net/en/", "http://xexample.net/en/", "ftp://example.com/de/", "http://b.org/fr/#t", "http://b.org/de/", "x://net/?/en/", "a://b://c.net/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, url_rules.RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.net", "", None, "allow") and got[4][2:] == ("net/", "block")
    assert got[5] == ("example.net", "/en/1", "example.net/en/", "allow") and got[6][3] == "allow" and got[7][2:] == ("net/", "block")
    assert got[8][2:] == ("example.com/de/", "block") and got[9][2:] == ("org/fr/", "allow") and got[10][2] is None
    assert got[11] == ("net", "/", "net/", "block")
    assert got[12][0] == "b:"
    assert url_rules.judge_urls(pages.where("false"), url_rules.RULES).count() == 0
    both = [url_rules.Rule("allow", "a.com", "/"), url_rules.Rule("block", "a.com", "/")]
    assert url_rules.judge_urls(spark.createDataFrame([(1, "h://a.com/")], "page_id long, url string"), both).first().verdict == "block"


def test_top_k_repeated_ids_and_ties(spark):
    same = [(50, "a b c d"), (50, "a b c d"), (50, "a b"), *((i, "a b c d") for i in range(1, 30)), (100, "c d e")]
    table = spark.createDataFrame(same, "doc_id long, text string")
    got = [(r.query_id, r["rank"], r.doc_id) for r in search.top_k(table, F.col("doc_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(50, 1, 50), (50, 2, 1), (50, 3, 2), (100, 1, 100), (100, 2, 1), (100, 3, 2)]


def test_url_rules_as_a_table(spark, monkeypatch):
    rules = [*url_rules.RULES, url_rules.Rule("block", "example.net", "/en/pri"), url_rules.Rule("allow", "example.net", "/en/private/x"), url_rules.Rule("block", "a.b.org", ""), url_rules.Rule("allow", "ORG", "/fr"), url_rules.Rule("block", "org", "/fr")]
    hosts, paths = ["net", "example.net", "m.example.net", "example.com", "a.b.org", "x.a.b.org", "org", "", "Example.NET", "a..net"], ["", "/", "/en", "/en/", "/en/private", "/en/private/x/y", "/en/pr", "/de/", "/fr/a", "/fr", "//fr/"]
    urls = [None, "none", *(f"http://{h}{p}?q" for h in hosts for p in paths)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def brute(host, path):
        fits = [(len(r.host), len(r.path), r.verdict == "block", r) for r in rules if ("." + host).endswith("." + r.host.lower()) and path.startswith(r.path)]
        return max(fits)[3] if fits else None

    shown = lambda df: sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect())
    trie = url_rules.judge_urls(pages, rules).collect()
    for r in trie:
        want = brute(r.host, r.path)
        assert (r.verdict, (r.rule or "").lower()) == ((want.verdict, want.label.lower()) if want else ("allow", ""))
    monkeypatch.setattr(url_rules, "MAX_BROADCAST_RULES", 3)
    table = url_rules.judge_urls(pages, rules)
    low = lambda rows: [(a, b, c, (d or "").lower(), e) for a, b, c, d, e in rows]
    assert low(shown(table)) == low(sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in trie))


def test_unreadable_media_give_an_error_row(spark):
    table = spark.createDataFrame([(1, bytearray(b"RIFF")), (2, bytearray(b"no avi at all, but long enough to look for an index")), (3, None)], "doc_id long, media binary")
    got = media.clips(table).collect()
    assert sorted(r.doc_id for r in got) == [1, 2] and all(r.error and r.clip is None for r in got)
