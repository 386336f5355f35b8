"""A hierarchical Pitman-Yor language model: Chinese restaurants for contexts, seated by sampling.

A token's context is the token before it; each context is a restaurant whose
tables are the customers of one parent restaurant, whose base is uniform over
the training vocabulary and one unknown token. A sweep reseats every dish of
every restaurant: its customers enter one by one and open a table with
probability (strength + discount * tables) * parent(dish) against those seated.
Tables of SAMPLES sweeps after BURN_IN are averaged into the predictive
probabilities. Within a sweep a dish sees the table total of the sweep before
(a blocked sampler), which lets dishes of one restaurant be seated in parallel;
the parent is seated once, from the averaged tables of its children, and dishes
see it through its token frequencies in steps of an eighth of a factor of two.

Work is dealt by chunks of documents, by ranges of words and by ranges of
contexts. A context with more tokens than a range should hold is dealt by its
next words, its table total is summed over ranges afterwards.
  1. chunks send distinct words with counts; word ranges answer with totals;
  2. chunks send distinct word pairs with counts; context ranges seat them and
     answer with what the pairs and contexts weigh, and send tables on;
  3. word ranges seat the parent; chunks score their texts.

Defined results: null counts as empty, which is one end token; a context never
seen gives the parent's probability; without training rows every token gets the
base; equal texts get equal scores; ids repeat freely and a null id trains; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import kernels as K
from assayer.llm.ranges import blobs, cuts, pack, part_of, sum_by_code, unpack
from assayer.llm.tables import discard, pieces, volume, written

CHUNK_BYTES = 8 << 20
BURN_IN, SAMPLES = 3, 3
DISCOUNT, STRENGTH = 0.85, 2.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.7, 10.0
END = np.uint64(0x0E4D0E4D0E4D0000)
_STEPS = 8  # of the parent's probability, to a factor of two


@dataclass
class Chunk:
    """A chunk's tokens as places in its sorted vocabulary, its distinct pairs, and which texts train."""

    ids: pa.ChunkedArray
    held_out: np.ndarray
    n_tokens: np.ndarray
    doc: np.ndarray
    words: np.ndarray
    token: np.ndarray
    train: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair: np.ndarray
    pair_train: np.ndarray


def _held_out(i, mod: int, rest: int) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % mod == rest


def _read(group: pa.Table, key: str, mod: int, rest: int, pairs: bool = True) -> Chunk:
    hashes, counts = [], []
    for part in K.blocks(K.buffers(group.column("_text"))):
        h, n = K.word_hashes(part)
        hashes.append(h)
        counts.append(n)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    total = n + 1
    ends = np.cumsum(total) - 1
    code = np.empty(int(total.sum()), np.uint64)
    is_end = np.zeros(len(code), bool)
    is_end[ends] = True
    code[is_end], code[~is_end] = END >> np.uint64(16), flat >> np.uint64(16)
    words, token = np.unique(code, return_inverse=True)
    held = np.array([_held_out(i, mod, rest) for i in group.column(key).to_pylist()], bool)
    doc = np.repeat(np.arange(len(n)), total)
    weight = ~held[doc]
    train = np.bincount(token[weight], minlength=len(words))
    empty = np.zeros(0, np.int64)
    left = right = pair = pair_train = empty
    if pairs and len(token):
        before = np.empty_like(token)
        before[1:] = token[:-1]
        starts = np.cumsum(total) - total
        before[starts] = np.searchsorted(words, END >> np.uint64(16))
        both, pair = np.unique(before.astype(np.int64) * len(words) + token, return_inverse=True)
        left, right = both // len(words), both % len(words)
        pair_train = np.bincount(pair[weight], minlength=len(both))
    return Chunk(group.column(key), held, total, doc, words, token, train, left, right, pair, pair_train)


def _send_words(key: str, n: int, mod: int, rest: int):
    def run(group: pa.Table) -> pa.Table:
        chunk = group.column("_chunk")[0].as_py()
        c = _read(group, key, mod, rest, pairs=False)
        part = part_of(c.words, n)
        at, ends = cuts(part)
        return pa.table({
            "_range": pa.array(part[at], pa.int64()), "_chunk": pa.array([chunk] * len(at), pa.int64()),
            "codes": pa.array([pack(c.words[x:y]) for x, y in zip(at, ends, strict=True)], pa.binary()),
            "counts": pa.array([c.train[x:y].astype("<u4").tobytes() for x, y in zip(at, ends, strict=True)], pa.binary()),
        })

    return run


def _answer_words(group: pa.Table) -> pa.Table:
    codes = [unpack(x.as_py()) for x in group.column("codes")]
    distinct, total, place = sum_by_code(np.concatenate(codes), np.concatenate(blobs(group, "counts", "<u4")))
    answer = total[place].astype("<u8")
    ends = np.cumsum([0, *map(len, codes)])
    rows = len(codes)
    hot = np.flatnonzero(total * 64 > total.sum())
    first = lambda v, rest: pa.array([v, *[rest] * (rows - 1)])
    return pa.table({
        "_chunk": group.column("_chunk"), "_range": group.column("_range"),
        "counts": pa.array([answer[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)], pa.binary()),
        "tokens": first(int(total.sum()), 0), "types": first(int((total > 0).sum()), 0),
        "hot": pa.array([[{"code": int(distinct[i]), "n": int(total[i])} for i in hot], *[[]] * (rows - 1)], pa.list_(pa.struct([("code", pa.int64()), ("n", pa.int64())]))),
    })


def _totals(c: Chunk, answers: pa.Table) -> np.ndarray:
    """The corpus counts of the chunk's words: the answers of all ranges in order."""
    answers = answers.sort_by("_range")
    return np.concatenate(blobs(answers, "counts", "<u8")).astype(np.float64) if answers.num_rows else np.zeros(0)


def _pair_order(c: Chunk, n: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the chunk's pairs by range, context and word, and their ranges in that order."""
    u, w = c.words[c.left], c.words[c.right]
    part = part_of(u, n)
    wide = np.isin(u, hot)
    part[wide] = part_of(K.mix(u[wide] * K.MULT + w[wide]) >> np.uint64(16), n)
    order = np.lexsort((w, u, part))
    return order, part[order]


def _send_pairs(key: str, n: int, mod: int, rest: int, hot_codes, tokens: int):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = group.column("_chunk")[0].as_py() if group.num_rows else -1
        c = _read(group, key, mod, rest)
        share = (_totals(c, answers) + 1) / (tokens + 1)
        step = np.clip(np.round(-np.log2(share) * _STEPS), 0, 255).astype(np.uint64) if len(c.words) else np.zeros(0, np.uint64)
        order, part = _pair_order(c, n, hot_codes.value[0])
        u, w, count = c.words[c.left[order]], c.words[c.right[order]], c.pair_train[order]
        entry = w << np.uint64(16) | np.minimum(count, 255).astype(np.uint64) << np.uint64(8) | step[c.right[order]]
        at, ends = cuts(part)
        rows = []
        for x, y in zip(at, ends, strict=True):
            first, last = cuts(u[x:y])
            big = count[x:y]
            rows.append((int(part[x]), chunk, pack(u[x:y][first]), (last - first).astype("<u4").tobytes(), entry[x:y].astype("<u8").tobytes(), big[big >= 255].astype("<u4").tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        return pa.table([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["_range", "_chunk", "contexts", "sizes", "entries", "big"])

    return run


def seat(count: np.ndarray, rate: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes whose customers enter one by one; rate is (strength + discount * tables) * parent.
    The first 256 customers are seated singly, later ones in steps of a thirty-second of those seated."""
    tables = np.minimum(count, 1).astype(np.float64)
    live = np.flatnonzero(count > 1)
    live = live[np.argsort(-count[live], kind="stable")]
    seated = 1
    while len(live):
        take = max(1, seated // 32) if seated >= 256 else 1
        n = np.minimum(count[live] - seated, take)
        p = rate[live] / (rate[live] + np.maximum(seated - discount * tables[live], 1e-9))
        tables[live] += rng.random(len(live)) < p if take == 1 else rng.binomial(n.astype(np.int64), p)
        seated += take
        live = live[: np.searchsorted(-count[live], -seated, side="left")]
    return tables


def _answer_pairs(n: int, hot_codes):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_chunk")
        here = group.column("_range")[0].as_py()
        contexts = [unpack(x.as_py()) for x in group.column("contexts")]
        sizes, entries, big = blobs(group, "sizes", "<u4"), blobs(group, "entries", "<u8"), blobs(group, "big", "<u4")
        u = np.repeat(np.concatenate(contexts), np.concatenate(sizes))
        e = np.concatenate(entries)
        w, count = e >> np.uint64(16), (e >> np.uint64(8) & np.uint64(255)).astype(np.int64)
        count[count == 255] = np.concatenate(big)
        order = np.lexsort((w, u))
        su, sw = u[order], w[order]
        new = np.ones(len(order), bool)
        new[1:] = (su[1:] != su[:-1]) | (sw[1:] != sw[:-1])
        head = np.flatnonzero(new)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        c = np.add.reduceat(count[order], head)
        parent = 2.0 ** (-(e[order][head] & np.uint64(255)).astype(np.float64) / _STEPS)
        du = su[head]
        first, last = cuts(du)
        context = np.repeat(np.arange(len(first)), last - first)
        names = du[first]
        # A context dealt over all ranges: its tables here stand for its share of customers here.
        codes, totals = hot_codes.value
        local = np.add.reduceat(c, first).astype(np.float64)
        wide = np.isin(names, codes)
        scale = np.ones(len(names))
        scale[wide] = totals[np.searchsorted(codes, names[wide])] / np.maximum(local[wide], 1)
        rng = np.random.default_rng(here)
        tables, mean, kept = np.minimum(c, 1).astype(np.float64), np.zeros(len(c)), np.zeros(len(names))
        for sweep in range(BURN_IN + SAMPLES):
            total = np.add.reduceat(tables, first)
            tables = seat(c, (STRENGTH + DISCOUNT * (total * scale)[context]) * parent, DISCOUNT, rng)
            if sweep >= BURN_IN:
                mean += tables / SAMPLES
                kept += np.add.reduceat(tables, first) / SAMPLES
        weight = np.where(c > 0, c - DISCOUNT * mean, 0.0)
        code = np.where(c <= 1, c, 255).astype(np.uint8)
        rows, at, ctx = [], 0, np.searchsorted(names, np.concatenate(contexts))
        base = 0
        for i, (k, m) in enumerate(zip(contexts, entries, strict=True)):
            p = place[at : at + len(m)]
            rows.append((group.column("_chunk")[i].as_py(), here, code[p].tobytes(), weight[p][code[p] == 255].astype("<f4").tobytes(), kept[ctx[base : base + len(k)]].astype("<f4").tobytes(), None, None, None))
            at, base = at + len(m), base + len(k)
        seen = c > 0
        words, tabled, _ = sum_by_code(sw[head][seen], mean[seen])
        part = part_of(words, n)
        for x, y in zip(*cuts(part), strict=True):
            rows.append((None, int(part[x]), None, None, None, pack(words[x:y]), tabled[x:y].astype("<f4").tobytes(), None))
        if wide.any():
            rows.append((None, None, None, None, None, None, None, [{"code": int(a), "tables": float(b)} for a, b in zip(names[wide], kept[wide], strict=True)]))
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.struct([("code", pa.int64()), ("tables", pa.float64())])))
        return pa.table([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_chunk", "_range", "code", "weight", "tables", "words", "tabled", "hot"])

    return run


def _answer_parent(types: int):
    def run(lists: pa.Table, tabled: pa.Table) -> pa.Table:
        if not lists.num_rows:
            return pa.table({"_chunk": pa.array([], pa.int64()), "_range": pa.array([], pa.int64()), "parent": pa.array([], pa.binary()), "customers": pa.array([], pa.float64()), "seated": pa.array([], pa.float64())})
        here = lists.column("_range")[0].as_py()
        if tabled.num_rows:
            words, customers, _ = sum_by_code(np.concatenate([unpack(x.as_py()) for x in tabled.column("words")]), np.concatenate(blobs(tabled, "tabled", "<f4")).astype(np.float64))
        else:
            words, customers = np.zeros(0, np.uint64), np.zeros(0)
        rate = np.full(len(words), (PARENT_STRENGTH + PARENT_DISCOUNT * types) / (types + 1))
        tables = seat(np.maximum(np.round(customers), 1).astype(np.int64), rate, PARENT_DISCOUNT, np.random.default_rng(here))
        weight = np.append(np.maximum(customers - PARENT_DISCOUNT * tables, 0.0), 0.0)
        rows = []
        for i, blob in enumerate(lists.column("codes")):
            codes = unpack(blob.as_py())
            at = np.searchsorted(words, codes)
            at[(at == len(words)) | (words[np.minimum(at, len(words) - 1)] != codes if len(words) else True)] = len(words)
            rows.append((lists.column("_chunk")[i].as_py(), here, weight[at].astype("<f8").tobytes(), float(customers.sum()) if not i else 0.0, float(tables.sum()) if not i else 0.0))
        columns = list(zip(*rows, strict=True))
        return pa.table([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64()), strict=True)], names=["_chunk", "_range", "parent", "customers", "seated"])

    return run


def _score(key: str, n: int, mod: int, rest: int, hot_codes, hot_tables, tokens: int, types: int, customers: float, seated: float):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            empty = pa.array([], pa.int64())
            return pa.table([group.column(key), pa.array([], pa.bool_()), empty, empty, empty, pa.array([], pa.float64()), pa.array([], pa.float64())], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        c = _read(group, key, mod, rest)
        kind = lambda name: answers.filter(answers.column(name).is_valid()).sort_by("_range")
        total = _totals(c, kind("counts"))
        parent = np.concatenate(blobs(kind("parent"), "parent", "<f8"))
        parent = parent / (PARENT_STRENGTH + customers) + (PARENT_STRENGTH + PARENT_DISCOUNT * seated) / (PARENT_STRENGTH + customers) / (types + 1)
        found = kind("code")
        order, part = _pair_order(c, n, hot_codes.value[0])
        code = np.concatenate(blobs(found, "code", "u1"))
        weight = np.where(code == 1, 1 - DISCOUNT, 0.0)
        weight[code == 255] = np.concatenate(blobs(found, "weight", "<f4"))
        u = c.left[order]
        first, last = cuts(part * len(c.words) + u)
        tables = np.repeat(np.concatenate(blobs(found, "tables", "<f4")).astype(np.float64), last - first)
        wide = np.isin(c.words[u], hot_codes.value[0])
        tables[wide] = hot_tables.value[np.searchsorted(hot_codes.value[0], c.words[u[wide]])]
        p = np.empty(len(order))
        p[order] = (weight + (STRENGTH + DISCOUNT * tables) * parent[c.right[order]]) / (STRENGTH + total[u])
        docs = len(c.n_tokens)
        by_doc = lambda v: np.bincount(c.doc, weights=v, minlength=docs)
        base = np.log10((total + 1) / (tokens + types + 1))
        return pa.table({
            key: c.ids, "held_out": c.held_out, "n_tokens": c.n_tokens.astype(np.int64), "n_known": by_doc((total > 0)[c.token]).astype(np.int64),
            "train_tokens": np.full(docs, tokens, np.int64), "base_score": by_doc(base[c.token]), "score": by_doc(np.log10(p)[c.pair]),
        })

    return run


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", mod: int = 7, rest: int = 2) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of each whole text).
    Texts whose crc32(id as text) mod `mod` is `rest` are held out of the training."""
    sc = docs.sparkSession.sparkContext
    _, total = volume(docs, text)
    n = pieces(total, CHUNK_BYTES)
    plain = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.pmod(F.xxhash64(F.col(key)), F.lit(n)).alias("_chunk"))
    by_chunk = plain.groupBy("_chunk")
    lists = written(by_chunk.applyInArrow(_send_words(key, n, mod, rest), "_range long, _chunk long, codes binary, counts binary"), "lm-words")
    counts = written(lists.groupBy("_range").applyInArrow(_answer_words, "_chunk long, _range long, counts binary, tokens long, types long, hot array<struct<code:long,n:long>>"), "lm-counts")
    tokens, types = (int(x or 0) for x in counts.agg(F.sum("tokens"), F.sum("types")).first())
    # At most n words can have more than one n-th of all tokens: they fit the driver.
    wide = sorted((r["code"], r["n"]) for r in counts.select(F.inline("hot")).where(F.col("n") * n > tokens).collect()) if n > 1 else []
    hot = sc.broadcast((np.array([x for x, _ in wide], np.uint64), np.array([x for _, x in wide], np.float64)))
    sent = by_chunk.cogroup(counts.groupBy("_chunk")).applyInArrow(_send_pairs(key, n, mod, rest, hot, tokens), "_range long, _chunk long, contexts binary, sizes binary, entries binary, big binary")
    seats = written(sent.groupBy("_range").applyInArrow(_answer_pairs(n, hot), "_chunk long, _range long, code binary, weight binary, tables binary, words binary, tabled binary, hot array<struct<code:long,tables:double>>"), "lm-seats")
    summed = {r["code"]: r["t"] for r in seats.where("hot is not null").select(F.inline("hot")).groupBy("code").agg(F.sum("tables").alias("t")).collect()}
    hot_tables = sc.broadcast(np.array([summed.get(x, 0.0) for x, _ in wide]))
    tabled = seats.where("words is not null").select("_range", "words", "tabled")
    parent = written(lists.select("_range", "_chunk", "codes").groupBy("_range").cogroup(tabled.groupBy("_range")).applyInArrow(_answer_parent(types), "_chunk long, _range long, parent binary, customers double, seated double"), "lm-parent")
    customers, seated = (float(x or 0) for x in parent.agg(F.sum("customers"), F.sum("seated")).first())
    discard(lists)
    answers = counts.select("_chunk", "_range", "counts").unionByName(seats.where("code is not null").select("_chunk", "_range", "code", "weight", "tables"), allowMissingColumns=True).unionByName(parent.select("_chunk", "_range", "parent"), allowMissingColumns=True)
    kind = docs.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_chunk.cogroup(answers.groupBy("_chunk")).applyInArrow(_score(key, n, mod, rest, hot, hot_tables, tokens, types, customers, seated), out)
