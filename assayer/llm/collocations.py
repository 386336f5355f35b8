"""Phrase collocations: candidates by sketch bounds, counted by Aho-Corasick automata shard by shard.

1. Every run of one or two words adds one to a cell in each row of a count-min
   sketch; the least of a run's cells is never below its count. Longer runs follow
   in sketches of their own, a word at a time, and only where the two runs without
   the first and without the last word may be frequent. Cells stop at FULL, so a
   cell is a byte, and partial sketches add up block by block.
2. A run whose bounds, its own and those of the runs inside, reach `least` may be
   frequent. Each shard (texts of about SHARD_BYTES) compiles the runs of its own
   texts that may be into an automaton and scans its texts with it. Words and
   patterns stand between blanks, and a mark that no word can be stands between
   pieces, so matches are of whole words, overlap, and never cross a piece.
3. The shards' counts are summed by phrase and the threshold is applied to the
   sums, which are exact: a run at or above it has a bound at or above it, so each
   shard that holds it has counted it.

A shard's automaton holds runs of the shard only, so its size is bounded by the
shard's, whatever the number of phrases in the table. Sketches are broadcast; one
has ROWS times `cells` bytes, a cell for two bytes of text but at most MAX_CELLS
(48 MB in all): beyond that size bounds get looser, more runs are counted, and
the sums stay exact.

Defined results: a null text is empty, a null language `und`; languages never
meet; a phrase is known by its words' bytes, A-Z lower-cased; repeated rows count
each time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import operator
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import kernels as K
from assayer.llm.tables import cores, volume, written
from assayer.llm.word_ids import WordIds, raw_texts, text_blocks

SHARD_BYTES = 3 << 20
#: Input splits that one task takes where there are more than two tasks a core: what it adds up itself is not sent.
SPLITS = 4
ROWS, FULL = 3, 255
MIN_CELLS, MAX_CELLS, PART = 1 << 16, 1 << 24, 1 << 16
#: Salts of the first of two rounds of ranking, so that no task ranks all phrases of a language.
SALTS = 64
#: 10^6 a a has at most 7 + 15 + 15 digits: counts below 10^15 are exact.
SCORE = "(CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(1000000 AS DECIMAL(7, 0))) div (CAST(l AS DECIMAL(15, 0)) * CAST(r AS DECIMAL(15, 0)))"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CUT = re.compile(rb"[.,;:!?\x0a-\x0d]+")
_MARK = b"."  # parts pieces, so it is in no word
#: So many at a time that cells of 16 bits hold what they add to FULL.
_STEP = 60_000
_SEEDS = K.mix(np.arange(1, ROWS + 1, dtype=np.uint64) * K.MULT)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, with a mark between pieces."""
    return _CUT.sub(b" . ", text.translate(_LOWER)).split()


class Words(WordIds):
    """Numbers of words, number 0 being the mark, and a hash of each that all partitions agree on."""

    def __init__(self):
        super().__init__((_MARK,))
        self.hashes = np.zeros(1, np.uint64)

    def hashed(self) -> np.ndarray:
        new = self.list[len(self.hashes) :]
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        return self.hashes


def frequent_runs(ids: np.ndarray, hashes: np.ndarray, lang: np.uint64, bounds: list[np.ndarray], least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, the places where a run of n words starts that may be frequent) as far as bounds tell, then the places of the next length that they leave open."""
    ok = ids != 0
    for n in range(1, len(bounds) + 2):
        at = np.flatnonzero(ok)
        if n <= len(bounds):
            may = np.ones(len(at), bool)
            for row, cell in zip(bounds[n - 1], cell_of(lang, hashes, ids, n, at, bounds[n - 1].shape[1]), strict=True):
                may &= row[cell] >= min(least, FULL)
            at = at[may]
        yield n, at
        ok = np.zeros(len(ids), bool)
        ok[at] = True
        ok[:-1] &= ok[1:]
        ok[-1:] = False


def cell_of(lang: np.uint64, hashes: np.ndarray, ids: np.ndarray, n: int, at: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """For each row of the sketch the cell of each run."""
    h = np.full(len(at), lang + np.uint64(n), np.uint64)
    for j in range(n):
        h = K.mix((h ^ hashes[ids[at + j]]) * K.MULT)
    for seed in _SEEDS:
        yield (K.mix(h + seed) & np.uint64(cells - 1)).astype(np.int64)


def _by_lang(batch: pa.RecordBatch) -> dict[str, bytes]:
    """The texts of each language one after the other, with a mark before each."""
    texts = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
        texts[lang].append(text)
    return {lang: _MARK.join([b"", *ts]) for lang, ts in texts.items()}


def _code(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def sketch(texts: DataFrame, cells: int, known: list[np.ndarray], lengths: int, least: int) -> np.ndarray:
    """(ROWS, cells) bounds, up to FULL, of the counts of the runs in texts (lang, text) of the `lengths` lengths that follow those known."""
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, cells), np.uint16)
        for b in text_blocks(batches, SHARD_BYTES // 2):
            for lang, text in _by_lang(b).items():
                words, code = Words(), _code(lang)
                ids = words.of(tokens(text))
                *_, (n, at) = frequent_runs(ids, words.hashed(), code, sent.value, least)
                for m in range(n, n + lengths):
                    for row, cell in zip(total, cell_of(code, words.hashes, ids, m, at, cells), strict=True):
                        for some in np.split(cell, range(_STEP, len(cell), _STEP)):
                            np.add.at(row, some, np.uint16(1))
                            row[some] = np.minimum(row[some], np.uint16(FULL))
                    at = at[: np.searchsorted(at, len(ids) - m)]
                    at = at[ids[at + m] != 0]
        for p, part in enumerate(total.reshape(-1, PART)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([zstandard.compress(part.astype(np.uint8).tobytes(), 1)], pa.binary())], names=["part", "n"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PART, np.int64)
        for b in batches:
            for n in b.column("n"):
                total += np.frombuffer(zstandard.decompress(n.as_py()), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, FULL).astype(np.uint8).tobytes()], pa.binary())], names=["part", "n"])

    parts = texts.mapInArrow(run, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary")
    out = np.zeros((ROWS * cells // PART, PART), np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"]] = np.frombuffer(r["n"], np.uint8)
    return out.reshape(ROWS, cells)


def _counted(lang: str, text: bytes, bounds: list[np.ndarray], least: int) -> tuple[list[str], np.ndarray, int]:
    """The runs of a shard's texts in a language that may be frequent, how often each occurs there, and the number of words."""
    words, listed = Words(), tokens(text)
    ids = words.of(listed)
    total, longest, patterns = int((ids != 0).sum()), len(bounds), []
    for n, at in itertools.islice(frequent_runs(ids, words.hashed(), _code(lang), bounds, least), longest):
        # Runs with the same words are one pattern: told by number, a word at a time.
        group = ids[at]
        for j in range(1, n):
            _, group = np.unique(group * len(words) + ids[at + j], return_inverse=True)
        _, first = np.unique(group, return_index=True)
        patterns += [b" ".join(listed[i : i + n]) for i in at[first].tolist()]
    counts = np.zeros(len(patterns), np.int64)
    if patterns:
        # Bytes as Latin-1 letters: one letter a byte, in the same order.
        names, automaton = [p.decode("latin-1") for p in patterns], ahocorasick.Automaton()
        for i, p in enumerate(names):
            automaton.add_word(f" {p} ", i)
        automaton.make_automaton()
        line = b" ".join([b"", *listed, b""]).decode("latin-1")
        counts = np.bincount(np.fromiter(map(operator.itemgetter(1), automaton.iter(line)), np.int64), minlength=len(patterns))
    return patterns, counts, total


def phrase_counts(texts: DataFrame, bounds: list[np.ndarray], least: int) -> DataFrame:
    """lang, phrase (UTF-8 bytes; empty: all words), n: the sums over shards of what may reach `least`."""
    sent = texts.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, SHARD_BYTES):
            for lang, text in _by_lang(b).items():
                patterns, counts, total = _counted(lang, text, sent.value, least)
                rows = len(patterns) + 1
                yield pa.RecordBatch.from_arrays([pa.array([lang] * rows, pa.string()), pa.array([*patterns, b""], pa.binary()), pa.array([*counts.tolist(), total], pa.int64())], names=["lang", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _blanks(phrase: str):
    """Where the blanks of a phrase are, from 1."""
    return F.expr(f"filter(sequence(1, octet_length({phrase})), i -> substring({phrase}, i, 1) = X'20')")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, shortest: int = 2, longest: int = 3, covered: int = 50, best: int = 2000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of shortest to longest words.

    A phrase occurs a >= least times; of its cuts in two parts with l and r occurrences the one with the least
    floor(10^6 a a / (l r)) counts, the first of equals; a phrase inside a longer one with covered percent of its
    occurrences or more is dropped.
    """
    texts = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    splits = texts.rdd.getNumPartitions()
    texts = texts.coalesce(min(splits, max(2 * cores(docs.sparkSession), splits // SPLITS)))
    size = volume(docs, text)[1]
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << int(size // 2).bit_length()))
    bounds = [sketch(texts, cells, [], 2, least)] * 2
    while len(bounds) < longest:
        bounds.append(sketch(texts, cells, bounds, 1, least))
    counted = written(phrase_counts(texts, bounds[:longest], least), "collocation-counts")
    words = counted.where(F.octet_length("phrase") == 0).select("lang", F.col("n").alias("all_words"))
    frequent = written(counted.where((F.octet_length("phrase") > 0) & (F.col("n") >= least)).withColumn("blanks", _blanks("phrase")), "collocation-phrases")
    candidates = frequent.where(F.size("blanks").between(shortest - 1, longest - 1))
    part = lambda name: frequent.select("lang", F.col("phrase").alias(f"{name}_part"), F.col("n").alias(name))
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), F.posexplode("blanks").alias("k", "i"))
    cuts = cuts.selectExpr("lang", "phrase", "a", "k", "substring(phrase, 1, i - 1) AS l_part", "substring(phrase, i + 1) AS r_part")
    cuts = cuts.join(part("l"), ["lang", "l_part"]).join(part("r"), ["lang", "r_part"])
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("cut"))
    # The runs of two or more words inside each candidate, with its occurrences.
    spots = F.expr("concat(array(0), blanks, array(octet_length(phrase) + 1))")
    inner = candidates.where(F.size("blanks") > shortest - 1).select("lang", "phrase", "n", spots.alias("spots"))
    inner = inner.select("lang", "phrase", "n", "spots", F.posexplode("spots").alias("i", "x")).select("lang", "phrase", "n", "i", "x", F.posexplode("spots").alias("j", "y"))
    inside = inner.where(F.col("j") - F.col("i") >= shortest).selectExpr("lang", "substring(phrase, x + 1, y - x - 1) AS inside", "phrase", "n").where("inside <> phrase")
    most = inside.groupBy("lang", F.col("inside").alias("phrase")).agg(F.max("n").alias("longer"))
    kept = scored.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    ahead = flat.withColumn("_place", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("_place") <= best)
    first = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    long = lambda c: F.col(c).cast("long").alias(c)
    return first.join(words.withColumnRenamed("all_words", "n"), "lang").select("lang", long("rank"), F.decode("phrase", "UTF-8").alias("phrase"), "a", "l", "r", "n", long("score"))


ORACLE = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), placed AS (
  SELECT id, lang, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM pieces
), nexts AS (
  SELECT lang, a, lead(a, 1) OVER byid AS b, lead(a, 2) OVER byid AS c FROM placed WINDOW byid AS (PARTITION BY id ORDER BY i)
), runs AS (
  SELECT lang, 1 AS k, a AS phrase FROM nexts
  UNION ALL SELECT lang, 2, a || ' ' || b FROM nexts WHERE b IS NOT NULL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM nexts WHERE c IS NOT NULL
), f AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, cut, l.a AS l, r.a AS r, (1000000 * c.a::HUGEINT * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM f AS c CROSS JOIN (VALUES (1), (2)) AS t(cut)
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
  WHERE c.k > 1 AND cut < c.k
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM f WHERE k = 3
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM inside GROUP BY ALL
), words AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, s.a DESC, phrase) AS rank, phrase, s.a AS a, l, r, n, score::BIGINT AS score
FROM scored AS s LEFT JOIN longer USING (lang, phrase) JOIN words USING (lang)
WHERE longer.a IS NULL OR 100 * longer.a < 50 * s.a
QUALIFY rank <= 2000
"""
