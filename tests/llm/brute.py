"""Plain Python versions of the operators, and small hostile tables."""

import collections
import hashlib
import math
import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, score double"


def hostile(spark):
    """Nulls in each column, empty and blank texts, a very long text, ties, repeats, and columns with clashing names."""
    rnd = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "über", "naïve", "x", "1d10t", "中文", "🙂", "end."]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, long = text(60), text(20_000)
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, base), (5, base), (6, base + " tail of a copy"), (7, long), (8, "Beta " * 300),
        (9, "prefix " + base[10:]), (10, "one two"), (50, base.upper()), (100, text(40)), (7 * 50, long[:500]), (None, base), (-3, text(30) + base[:70]), (11, "a\u0085b\u00a0c <|endoftext|> Σας İ"),
    ]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", "s", None if t is None else len(t), "clash", 0.5) for i, t in rows], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, percent=75):
    """{id: smallest id reachable} for rows of (id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def repeats(rows, length=50):
    """[(n_bytes, n_removed, n_spans, sha256)] in the order of rows (id, text); a null id is larger than all."""
    large = max((i for i, _ in rows if i is not None), default=0) + 1
    rows = [(large if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in rows:
        for x in range(len(t) - length + 1):
            least[t[x : x + length]] = min(i, least.get(t[x : x + length], i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for x in range(len(t) - length + 1):
            if least[t[x : x + length]] < i:
                gone[x : x + length] = b"\1" * length
        spans = sum(g and (x == 0 or not gone[x - 1]) for x, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def top_k(rows, is_query, k):
    docs = {i: collections.Counter(words(t)) for i, t in rows if i is not None}
    size = {i: sum(c.values()) for i, c in docs.items()}
    df = collections.Counter(w for c in docs.values() for w in c)
    n, mean = len(docs), sum(size.values()) / max(len(docs), 1)
    out = {}
    for q in filter(is_query, docs):
        found = []
        for i, c in docs.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for w in docs[q] if w in c)
            if s:
                found.append((-round(s, 9), i))
        out[q] = sorted(found)[:k]
    return out


def base_scores(rows, mod=7, rest=2):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % mod == rest
    tokens = [(i, [*words(t), b"\0end"]) for i, t in rows]
    c = collections.Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    return [(held(i), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in tokens]
