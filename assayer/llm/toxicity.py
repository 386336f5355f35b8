"""Toxicity: a noisy channel restores disguised words, then learned weights score the restored text.

A word is disguised if it mixes letters with other signs, repeats a letter three
times or more, or stands as single characters with gaps. Its lattice has, for
each sign, the letters the sign may stand for, a separator as nothing or as the
end of a word, a first sign as nothing, and a run of equal letters as one or
two, each at a cost. Viterbi decoding over all pairs of last letters, under a
character trigram model counted over all texts, finds the cheapest reading of
the whole word, whatever its length. Only the reading is scored. Plain words stand.

The trigram model knows LETTERS, the end of a word, and one symbol for all other
letters; its table has their number to the power of three entries.

Weights are learned from labelled rows only (at most MAX_LABELLED): a feature is
a restored word or its first 3 to 6 letters, counted once a document, and kept
if its log-likelihood ratio exceeds MIN_LLR; a logistic curve over a document's
strongest and summed weight gives the score.

Defined results: null counts as empty and, like any text without a kept feature,
gets the score of no evidence; equal texts have equal scores; equally cheap
readings go by the alphabet; without labelled rows of both kinds every score is
the share of toxic rows (0.5 without rows, not predicted); ids repeat freely;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import kernels as K
from assayer.llm.bpe import Table, raw
from assayer.llm.quality import labelled_texts
from assayer.llm.tables import refuse_clashes, written

MAX_LABELLED = 200_000
MIN_LLR = 24.0
CACHED_WORDS = 200_000
#: Words longer than this are read anew each time.
KEPT_LENGTH = 64
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)

# What a sign may stand for in a disguised word.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c",
}
SEPARATORS = set(".-_*~'`^,:;/\\ ")
_EDGE = ".,;:!?\"'()[]{}<>*%&#$|+-_~^`/\\=«»“”„…¡¿"
_SPACED = re.compile(r"(?<!\S)(?:[^\s][ .\-_*]{1,2}){2,}[^\s](?![^\s.,;:!?])")
_RUN = re.compile(r"(\w)\1{2,}")
_LETTER, _TAIL = np.zeros(256, np.int64), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1  # 0xC3 begins the letters of Latin-1
_LETTER[[0x97, 0xB7]] = 0  # the two of them that are no letters
_TAIL[[ord(c) for c in ".,;:?!\"')"]] = True  # of _EDGE


#: Costs of the channel: a sign for a letter, two letters for a long run, one separator as the end of a word, a first sign that is no letter, and a bracket there.
SUBSTITUTE, DOUBLE, SPLIT, DROP, BRACKET = 1.0, 0.5, 1.0, 3.0, 0.0
_END, _OTHER = 0, len(LETTERS) + 1
SYMBOLS = len(LETTERS) + 2
_AT = {c: i + 1 for i, c in enumerate(LETTERS)} | {"$": _END}
_BREAK = 255
_SYMBOL = np.full(0x250, _OTHER, np.uint8)
for _c in range(0xDF):
    _SYMBOL[_c] = _AT.get(chr(_c), _BREAK if chr(_c) in SIGNS else _END) if chr(_c) != "$" else _BREAK
_SYMBOL[0xF7] = _END
for _c, _i in _AT.items():
    if _c != "$":
        _SYMBOL[ord(_c)] = _i


class CharModel:
    """Costs (negative log probabilities) of the third symbol after two, from the counts of trigrams."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape((SYMBOLS,) * 3) + 0.01
        self.cost = (np.log(n.sum(axis=2, keepdims=True)) - np.log(n)).tolist()

    def spoken(self, state: tuple[int, int], letters: str) -> tuple[tuple[int, int], float]:
        """The state after the letters ('$' ends a word), and their cost."""
        (x, y), total = state, 0.0
        for c in letters:
            z = _AT.get(c, _OTHER)
            total += self.cost[x][y][z]
            x, y = (y, z) if z else (_END, _END)
        return (x, y), total

    def restore(self, word: str) -> str:
        """The cheapest reading of a disguised word; '$' parts the words of it."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(_END, _END): (0.0, None)}
        for options in lattice(word):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for state, (cost, said) in best.items():
                for letters, price in options:
                    if letters == "$" and state == (_END, _END):
                        after, more = state, 0.0
                    else:
                        after, more = self.spoken(state, letters)
                    total = cost + price + more
                    if after not in new or total < new[after][0]:
                        new[after] = (total, (letters, said) if letters else said)
            best = new
        _, said = min(((c + self.spoken(state, "$")[1] if state != (_END, _END) else c, said) for state, (c, said) in best.items()), key=lambda t: t[0])
        out = []
        while said:
            out.append(said[0])
            said = said[1]
        return "".join(out[::-1])


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of one character what it may stand for, and the cost of that."""
    steps, i = [], 0
    while i < len(word):
        c, j = word[i], i
        while j < len(word) and word[j] == c:
            j += 1
        if c in SEPARATORS:
            options = [("", 0.0), ("$", SPLIT if j - i == 1 else 0.0)]
        elif c in SIGNS:
            options = [(o, SUBSTITUTE) for o in SIGNS[c]]
            if j - i > 1:
                options += [(o * 2, SUBSTITUTE) for o in SIGNS[c]]
            if i == 0 and not c.isdigit():
                options.append(("", BRACKET if c in "(<" else DROP))
        elif not c.isalnum():
            options = [("", 0.0)]
        elif j - i > 2:
            options = [(c, 0.0), (c * 2, DOUBLE)]
        else:
            options = [(c * (j - i), 0.0)]
        steps.append(options)
        i = j
    return steps


def char_counts(docs: DataFrame, text: str = "text") -> CharModel:
    """The model of the trigrams of all words of all texts; at most SYMBOLS ** 3 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for part in K.blocks(K.buffers(b.column(0))):
                data = part.data.tobytes()
                if data.isascii():
                    code = np.frombuffer(data.lower(), np.uint8).astype(np.uint32)
                else:
                    code = np.frombuffer(data.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
                sign = np.concatenate([[_END, _END], _SYMBOL[np.minimum(code, 0x24F)], [_END]]).astype(np.int64)
                x, y, z = sign[:-2], sign[1:-1], sign[2:]
                x = np.where(y == _END, _END, x)  # a word starts after its end, whatever came before
                ok = (x != _BREAK) & (y != _BREAK) & (z != _BREAK) & ((y != _END) | (z != _END))
                total += np.bincount(((x * SYMBOLS + y) * SYMBOLS + z)[ok], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    rows = docs.select(text).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"]
    return CharModel(counts)


class Reader:
    """The restored words of texts and their features; what it found for a chunk of text is kept while there is room."""

    def __init__(self, model: CharModel, weights: dict[str, float] | None = None):
        self.model, self.weights, self.cache = model, weights, {}
        # A plain word has evidence only if it is a whole feature or starts as a prefix feature does.
        self.whole = {f[1:] for f in weights or () if f[0] == "="}
        self.starts = {f[:3] for f in weights or () if f[0] != "="}

    def may_tell(self, word: str) -> bool:
        return self.weights is None or word[:3] in self.starts or word in self.whole

    def words(self, chunk: str) -> list[str]:
        """The chunk as a plain word, or the words of its reading if it may be disguised."""
        bare = chunk.strip(_EDGE)
        core = chunk.strip(".,;:?\"'")
        masked = len(core) > 1 and core[0] in SIGNS and core[1].isalpha()
        if not bare or (not masked and bare.isalpha() and not _RUN.search(bare)):
            return [bare] if bare else []
        return [w for w in self.model.restore(core[0] + core[1:].rstrip(_EDGE) if masked else bare).split("$") if w]

    def features(self, word: str) -> list[str]:
        return ["=" + word, *(word[:k] for k in range(3, min(6, len(word)) + 1))]

    def found(self, words: list[str]) -> dict[str, float]:
        """Without weights: every feature, each 0. With weights: the words with evidence and the strongest weight of each."""
        if self.weights is None:
            return dict.fromkeys((f for w in words for f in self.features(w)), 0.0)
        get = self.weights.get
        best = {w: max((get(f, 0.0) for f in self.features(w)), default=0.0) for w in words}
        return {w: x for w, x in best.items() if x > 0}

    def chunk(self, chunk: bytes) -> dict[str, float]:
        found = self.cache.get(chunk)
        if found is None:
            text = chunk.decode("utf-8", "replace").lower()
            found = self.found([text] if text.isalpha() and not _RUN.search(text) else self.words(text))
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            if len(chunk) <= KEPT_LENGTH:
                self.cache[chunk] = found or _NOTHING
        return found

    def spaced(self, text: bytes) -> dict[str, float]:
        """What the runs of single characters with gaps read as."""
        found: dict[str, float] = {}
        for m in _SPACED.finditer(text.decode("utf-8", "replace").lower()) if _GAPS.search(text) else ():
            found.update(self.found([w for w in self.model.restore(m[0]).split("$") if w]))
        return found

    def text(self, text: bytes) -> dict[str, float]:
        found: dict[str, float] = {}
        for c in set(text.split()):
            if x := self.chunk(c):
                found.update(x)
        return found | self.spaced(text)


def _plain(d: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks are Latin-1 letters, surely no three alike in a row, before one mark at most; where the letters end."""
    letters = np.concatenate([[0], np.cumsum(_LETTER[d])])
    low = d | 32  # letters that differ by case are alike, and some more are
    end = y - (_TAIL[d[y - 1]] & (y - x > 1))
    fine = letters[end] - letters[x] == end - x
    for size in (1, 2):
        if len(d) > 2 * size:
            once = low[size:] == low[:-size]
            twice = once[size:] & once[:-size]
            if size == 2:
                twice[:-1] &= twice[1:]
            before = np.concatenate([[0], np.cumsum(twice)])
            at = lambda i: before[np.minimum(i, len(before) - 1)]  # noqa: B023, E731
            fine &= at(np.maximum(end - 3 * size + 1, x)) == at(x)
    return fine, end


class Scorer:
    """Evidence of many texts at a time: chunks are known by fingerprint, and only those with evidence are looked at again."""

    def __init__(self, reader: Reader):
        self.reader = reader
        self._clear()

    def _clear(self) -> None:
        self.table, self.found = Table(16), [_NOTHING]

    def texts(self, part: K.Texts) -> list[dict[str, float]]:
        """The evidence in each text."""
        if self.table.used > 10 * CACHED_WORDS:
            self._clear()
        s, e, counts = K.word_bounds(part)
        keys, first, place = np.unique((K.hashes_of(part, s, e) >> np.uint64(1)).view(np.int64), return_index=True, return_inverse=True)
        entry = self.table.get(keys)
        new = np.flatnonzero(entry < 0)
        data = part.data.tobytes()
        if len(new):
            x, y = s[first[new]], e[first[new]]
            plain, end = _plain(part.data, x, y)
            for k, x, y, z in zip(new.tolist(), x.tolist(), y.tolist(), np.where(plain, end, 0).tolist(), strict=True):
                if z:
                    word = data[x:z].decode().lower()
                    found = self.reader.found([word]) if self.reader.may_tell(word) else _NOTHING
                else:
                    found = self.reader.chunk(data[x:y])
                entry[k] = len(self.found) if found else 0
                if found:
                    self.found.append(found)
            self.table.add(keys[new], entry[new])
        out: list[dict[str, float]] = [_NOTHING] * len(part)
        which = entry[place]
        at = np.flatnonzero(which > 0)
        text = np.searchsorted(np.cumsum(counts), at, side="right")
        # Each find of a text once, in the order of the text, so that equal texts add up alike.
        once = np.sort(np.unique(text * len(self.found) + which[at], return_index=True)[1])
        for t, w in zip(text[once].tolist(), which[at[once]].tolist(), strict=True):
            if out[t] is _NOTHING:
                out[t] = dict(self.found[w])
            else:
                out[t].update(self.found[w])
        if _GAPS.search(data):
            for t in range(len(part)):
                if more := self.reader.spaced(part.raw(t)):
                    out[t] = out[t] | more
        return out


_NOTHING: dict[str, float] = {}
_GAPS = re.compile(rb"(?<!\S)\S[\x80-\xBF]*[ .\-_*]{1,2}\S[\x80-\xBF]*[ .\-_*]{1,2}\S[\x80-\xBF]*(?!\S)")


@dataclass
class Classifier:
    model: CharModel
    weights: dict[str, float]
    curve: tuple[float, float, float]

    def evidence(self, found: dict[str, float]) -> tuple[float, float]:
        """The strongest word's weight, and the logarithm of that of all words together."""
        return (max(found.values()), math.log1p(sum(sorted(found.values())))) if found else (0.0, 0.0)

    def score(self, found: dict[str, float]) -> float:
        top, total = self.evidence(found)
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-(a * top + b * total + c))))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on two numbers a row, by Newton steps with a small ridge."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag([1e-2, 1e-2, 1e-4])
        step = np.linalg.solve(h, z.T @ (y - p) - np.array([1e-2, 1e-2, 1e-4]) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1]), float(w[2])


def train_classifier(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Classifier:
    """train: a condition on the labels' id, named _id."""
    model = char_counts(docs, text)
    sample = written(labelled_texts(docs, labels, label, key, text, train, MAX_LABELLED), "toxicity-labelled")
    n = {bool(r["y"]): r["n"] for r in sample.groupBy((F.col("_label") == 1).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    if not bad or not good:
        share = min(max(bad / (bad + good), 0.001), 0.999) if bad + good else 0.499
        return Classifier(model, {}, (0.0, 0.0, float(np.log(share / (1 - share)))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in batches:
            total: dict[str, list[int]] = {}
            for t, y in zip(raw(b.column(0)), b.column(1).to_pylist(), strict=True):
                for f in reader.text(t):
                    total.setdefault(f, [0, 0])[y == 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array([v[1] for v in total.values()], pa.int64()), pa.array([v[0] for v in total.values()], pa.int64())], names=["f", "bad", "good"])

    part = lambda k, e: k * F.log(F.greatest(k, F.lit(1e-9)) / e)
    share = bad / (bad + good)
    counted = sample.select("_text", "_label").mapInArrow(collect, "f string, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n_f = F.col("bad") + F.col("good")
    llr = 2 * (part(F.col("bad").cast("double"), n_f * share) + part(F.col("good").cast("double"), n_f * (1 - share)))
    rows = counted.where((llr > MIN_LLR) & (F.col("bad") > n_f * share)).collect()
    weights = {r["f"]: float(np.log((r["bad"] + 0.5) / (bad + 1)) - np.log((r["good"] + 0.5) / (good + 1))) for r in rows}
    clf = Classifier(model, weights, (0.0, 0.0, 0.0))
    seen = _scored(sample, clf, "_label", "_text", True).toPandas()
    clf.curve = _fit_curve(seen[["top", "total"]].to_numpy(), (seen["_label"] == 1).to_numpy().astype(float))
    return clf


def _scored(docs: DataFrame, clf: Classifier, key: str, text: str, evidence: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(clf)
    made = ["top", "total"] if evidence else ["score"]
    source = docs.select(text, key, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clf = shared.value
        scorer = Scorer(Reader(clf.model, clf.weights))
        for b in batches:
            found = [f for part in K.blocks(K.buffers(b.column(0))) for f in scorer.texts(part)]
            got = [clf.evidence(f) if evidence else (clf.score(f),) for f in found]
            columns = list(zip(*got, strict=True)) if got else [()] * len(made)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c, pa.float64()) for c in columns)], names=[key, *keep, *made])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep)]
    return source.mapInArrow(run, ", ".join([*fields, *(f"{n} double" for n in made)]))


def score_documents(docs: DataFrame, clf: Classifier, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in keep, score, predicted for each whole text. keep with a name of the result raises ValueError."""
    refuse_clashes(keep, key, "score", "predicted")
    return _scored(docs, clf, key, text, keep=keep).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def restored_texts(docs: DataFrame, model: CharModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, restored: each text with its disguised words replaced, white space as one blank."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            reader = Reader(shared.value)
            restored = [" ".join(" ".join(reader.words(w.lower())) or w for w in (t or "").split()) for t in b[text]]
            yield pd.DataFrame({key: b[key], "restored": restored})

    return docs.select(key, text).mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, restored string")
