"""Near-duplicates by fast similarity sketching, banding and exact verification.

A text's set is its distinct shingles of five words (A-Z lower-cased). The
sketch places the shingles in bins by rounds of hashing until each bin holds
one; the last rounds name their bin, so every bin fills. Equal sets collapse to
one class first. Classes that share a band of the sketch meet in that band's
group. The lead of a group is its most central member, the one with the most
band-mates over all its bands. While it pays, each class is compared, on full
sets, with the one lead that most of its groups name, and what is linked is
merged: near copies of one text thus cost a comparison each. Then every pair of
a group that is not merged yet is formed if the exact bounds below leave it
open, and verified. No group is cut short.

Bounds that lose no link: the sizes of two sets, and the parity of the number of
elements in each of PARITY hash cells. Cells of different parity hold at least
one element that only one of the sets has.

Groups of more than GROUP classes are dealt as pairs of parts of that size, so
that no task holds a whole one.

Defined results: null or blank texts have no shingles and stand alone; a text
of fewer than five words has one, its whole sequence; a null id stands alone
with a null component and is kept; equal texts are always together; rows with
one id are one document with the sets of all; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import kernels as K
from assayer.llm.graph import components
from assayer.llm.tables import discard, written

WORDS = 5
BINS, ROWS = 128, 4
#: Rounds of one comparison a class go on while more than one in PAYS finds a link.
PAYS = 4
GROUP = 1024
PARITY = 2048
FOLD = PARITY // 64 // 4


def _seeds(n: int) -> np.ndarray:
    return K.mix(np.arange(1, n + 1, dtype=np.uint64) * K.MULT)


def sketches(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(texts, bins): for each bin the hash of the element that the rounds put there; texts without elements give zeros."""
    n, seeds = len(counts), _seeds(2 * bins)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, bins), none)
    doc = np.repeat(np.arange(n), counts)
    live = values
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    for r in range(2 * bins):
        if not len(live):
            break
        h = K.mix(live + seeds[r]) | np.uint64(1)
        if r < bins:
            fresh = np.full((n, bins), none)
            np.minimum.at(fresh.reshape(-1), doc * bins + (h >> shift).astype(np.int64), h)
            out = np.where(out == none, fresh, out)
        else:
            fresh = np.full(n, none)
            np.minimum.at(fresh, doc, h)
            out[:, r - bins] = np.where(out[:, r - bins] == none, fresh, out[:, r - bins])
        open_ = (out == none).any(axis=1)
        keep = open_[doc]
        if not keep.all():
            live, doc = live[keep], doc[keep]
    out[counts == 0] = 0
    return out


def shingle_sets(part: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    return K.distinct_per_text(*K.grams(*K.word_hashes(part), WORDS))


def parities(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, PARITY / 64) words: bit i is the parity of the number of elements in cell i."""
    cell = (K.mix(values + np.uint64(37)) % np.uint64(PARITY)).astype(np.int64)
    full = np.bincount(np.repeat(np.arange(len(counts)), counts) * PARITY + cell, minlength=len(counts) * PARITY)
    return np.packbits((full & 1).astype(np.uint8).reshape(len(counts), PARITY), axis=1).view(np.int64)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_shingles, set_a, set_b (a fingerprint of the set), bands, parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in K.blocks(K.buffers(b.column(0)), 1 << 19):
                values, counts = shingle_sets(part)
                s = sketches(values, counts)
                band = np.zeros((len(part), BINS // ROWS), np.uint64)
                for j in range(ROWS):
                    band = K.mix(band * K.MULT + s[:, j::ROWS][:, : BINS // ROWS])
                ends = np.cumsum(counts)
                total = [np.concatenate([[np.uint64(0)], np.cumsum(K.mix(values + np.uint64(x)), dtype=np.uint64)]) for x in (11, 23)]
                a, c = ((t[ends] - t[ends - counts]).view(np.int64) for t in total)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(part.first, len(part)), pa.array(counts.astype(np.int64)), pa.array(a), pa.array(c), _lists(band.view(np.int64)), _lists(parities(values, counts))], names=[key, "n_shingles", "set_a", "set_b", "bands", "parity"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(text, key).mapInArrow(run, f"`{key}` {kind}, n_shingles long, set_a long, set_b long, bands array<long>, parity array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """id, shingles (sorted 64-bit values) of the documents in ids(id)."""
    wanted = docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).join(ids.hint("shuffle_hash"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in K.blocks(K.buffers(b.column(1))):
                values, counts = shingle_sets(part)
                ends = np.cumsum(counts)
                sets = [values[y - n : y].tobytes() for y, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.first, len(part)), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return wanted.mapInArrow(run, "id long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, lead) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("a")), "x").join(sets.select(F.col("id").alias("lead"), F.col("shingles").alias("b")), "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                at = np.searchsorted(a, b)
                common = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("x", "lead", "a", "b").mapInArrow(run, "u long, v long")


def _one_lead(placed: DataFrame, turn: int) -> DataFrame:
    """(x, lead): each class with the lead that most of its groups name, where their components differ."""
    weight = F.col("mates") * (1.0 if turn == 0 else F.pmod(F.xxhash64(F.lit(turn), "rep"), F.lit(1 << 20)))
    leads = placed.groupBy("key").agg(F.max(F.struct(weight.alias("w"), "rep", "comp")).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    named = placed.join(leads.select("key", "lead"), "key").where(F.col("comp") != F.col("lead.comp"))
    return named.groupBy(F.col("rep").alias("x")).agg(F.mode("lead.rep").alias("lead"))


def _open_pairs(placed: DataFrame, parity: DataFrame, percent: int) -> DataFrame:
    """(x, lead): all pairs of a group in different components that the exact bounds leave open."""
    groups = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.mode("comp").alias("main")).where("lo <> hi")
    parts = F.ceil(F.col("c") / GROUP).cast("int")
    folds = [F.col("parity")[k].bitwiseXOR(F.col("parity")[k + FOLD]).bitwiseXOR(F.col("parity")[k + 2 * FOLD]).bitwiseXOR(F.col("parity")[k + 3 * FOLD]).alias(f"f{k}") for k in range(FOLD)]
    left = placed.join(groups.select("key", "main"), "key").join(parity.select("*", *folds), "rep").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    every, own = F.explode(F.sequence(F.lit(0), parts - 1)), ["rep", "n", "comp", "parity", *(f"f{k}" for k in range(FOLD))]
    asking = left.where("comp <> main").select("key", F.col("part").alias("i"), every.alias("j"), *own)
    asked = left.select("key", every.alias("i"), F.col("part").alias("j"), "main", *[F.col(c).alias(f"b_{c}") for c in own])
    ones = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    # 100 * common >= percent * union: common >= percent * both / (100 + percent), so both - 2 * common <= (100 - percent) * both / (100 + percent)
    may = lambda differ: sum(differ, F.lit(0)) * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("b_n"))
    # The parities of a quarter as many cells, which are quicker to compare, come before all.
    near = (100 * F.least("n", "b_n") >= percent * F.greatest("n", "b_n")) & may(ones(F.col(f"f{k}"), F.col(f"b_f{k}")) for k in range(FOLD)) & may(ones(F.col("parity")[k], F.col("b_parity")[k]) for k in range(4 * FOLD))
    once = (F.col("b_comp") == F.col("main")) | (F.col("rep") > F.col("b_rep"))
    pairs = asking.join(asked, ["key", "i", "j"]).where((F.col("comp") != F.col("b_comp")) & once & near)
    return pairs.select(F.col("rep").alias("x"), F.col("b_rep").alias("lead")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (rep, comp) after the components that links (u, v) join have become one."""
    comp = labels.select(F.col("rep").alias("node"), F.col("comp").alias("c"))
    edges = links.join(comp.withColumnsRenamed({"node": "u", "c": "cu"}), "u").join(comp.withColumnsRenamed({"node": "v", "c": "cv"}), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    moved = components(edges).withColumnsRenamed({"node": "comp", "component": "to"})
    new = written(labels.join(moved, "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")), "neardup-labels")
    discard(labels)
    return new


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """key, n_shingles, component_id (the smallest id reachable over links), kept."""
    table = written(sketched(docs, key, text), "neardup-sketches")
    named = table.where(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    same = ["set_a", "set_b", "n_shingles"]
    first = F.min(F.struct(F.col(key).alias("rep"), "bands", "parity")).alias("first")
    classes = written(named.groupBy(*same).agg(first).select(*same, "first.*"), "neardup-classes")
    entries = classes.select("rep", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "rep", "n")
    crowded = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = written(entries.join(crowded, "key"), "neardup-entries")
    mates = written(met.groupBy("rep").agg(F.sum("c").alias("mates")), "neardup-mates")
    sets = written(full_sets(docs.where(F.col(key).isNotNull()), mates.select(F.col("rep").alias("id")), key, text), "neardup-sets")
    labels = written(classes.select("rep", F.col("rep").alias("comp")).distinct(), "neardup-labels")
    # Rows with one id but different sets are linked by their id.
    several = named.groupBy(key).agg(F.min(F.struct(*same)).alias("lo"), F.max(F.struct(*same)).alias("hi")).where("lo <> hi").select(key)
    named_twice = written(named.select(key, *same).join(several, key).join(classes.select(*same, "rep"), same).select(F.col(key).alias("id"), "rep"), "neardup-ids")
    if not named_twice.isEmpty():
        labels = _merged(labels, named_twice.groupBy("id").agg(F.min("rep").alias("u")).join(named_twice, "id").where("u <> rep").select("u", F.col("rep").alias("v")))
    parity, turn, asked, found = classes.select("rep", "parity"), 0, 0, 1
    while asked < PAYS * found or turn == 0:
        placed = met.join(labels, "rep").join(mates, "rep")
        pairs = written(_one_lead(placed, turn), "neardup-pairs")
        links = written(verified(pairs, sets, percent), "neardup-links")
        asked, found = pairs.count(), links.count()
        labels = _merged(labels, links) if found else labels
        discard(pairs, links)
        turn += 1
        if not found:
            break
    pairs = written(_open_pairs(met.join(labels, "rep"), parity, percent), "neardup-pairs")
    links = written(verified(pairs, sets, percent), "neardup-links")
    labels = _merged(labels, links)
    discard(pairs, links, sets, met, mates, named_twice)
    member = named.select(key, *same).join(classes.select(*same, "rep"), same).join(labels, "rep")
    named_as = member.groupBy(F.col(key).alias("id")).agg(F.min("comp").alias("component"))
    return table.select(F.col(key), "n_shingles").join(named_as, F.col(key) == F.col("id"), "left").select(
        F.col(key), "n_shingles", F.coalesce("component", F.col(key)).alias("component_id"), (F.col(key).isNull() | (F.col(key) == F.coalesce("component", F.col(key)))).alias("kept")
    )
