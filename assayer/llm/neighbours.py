"""Approximate nearest neighbours by largest inner product: p-stable hashing, multiprobe, exact reranking.

Vectors of one length are brought to the unit sphere: a vector x becomes x / m with
one more component that makes its norm 1, m being the largest norm, and a query
q / |q| with 0 there. Distances between the two then fall as inner products grow,
and the distance of an inner product is known.

Each of TABLES tables cuts several random projections (p-stable: normal) into
slots of WIDTH; the slots of a vector are its bucket. A query visits buckets in
the order of the estimated success of each, the product over the projections of
the normal probability that a point at distance r falls into the slot, until a
point at r is met in one of the tables with probability `success`. r is the
distance of the k-th best neighbour found so far: first a bound from a sample of
SAMPLE_ROWS rows at most, then the k-th best of the FIRST best buckets of each
table. So near queries stop early and far ones go on, and the recall aimed at is
the same for both. What the tables meet is merged and ranked by exact inner
products. A query that still has fewer than k neighbours visits every bucket.

Buckets are dealt to cells by hash; a bucket of more than CELL_ROWS rows (more in
tables of over CELL_ROWS * LARGE / TABLES rows, so that the list of such buckets,
which every task gets, stays bounded) is dealt to as many cells as it needs, and the queries of a cell come in blocks of about
QUERY_ROWS, so a task holds one cell and one block. Equal vectors of a cell beyond
the k + 1 of smallest id can be in no answer and are not compared. The sample
only starts the bound; the index holds every vector.

Defined results: vectors that are null, of no components, zero, or hold a null, NaN
or infinite component take no part, as query or candidate, nor do rows with a null
id; rows with one id count once, with the vector whose bytes are least; a query
meets vectors of its own length only; equal scores go by ascending id; fewer than k
candidates give fewer rows; scores are sums in the order of the components, in
double precision; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import kernels as K
from assayer.llm.tables import cores, written

TABLES, WIDTH = 2, 1.0
#: Rows that a bucket has on average in a table of evenly spread vectors, while that takes no more projections than MOST.
OCCUPANCY, MOST, BITS = 32, 12, 5
CELL_ROWS, QUERY_ROWS = 4096, 8192
#: Most buckets that are dealt to several cells; their list is sent to every task.
LARGE = 1 << 20
SAMPLE_ROWS, SAMPLE_BYTES = 1024, 8 << 20
FIRST = 8
SUCCESS = 0.95
_STEP = 1024


def projections(rows: int) -> int:
    """Each has about four slots in use, two bits of a bucket."""
    return min(MOST, max(1, round(math.log2(max(rows / OCCUPANCY, 1)) / 2)))


class Family:
    """The projections and offsets of vectors of one length."""

    def __init__(self, dim: int, rows: int, largest: float):
        rng = np.random.default_rng([dim, 7])
        self.m, self.rows, self.largest = projections(rows), rows, largest
        self.a = rng.standard_normal((TABLES, self.m, dim + 1))
        self.b = rng.random((TABLES, self.m)) * WIDTH

    def places(self, x: np.ndarray) -> np.ndarray:
        """(n, TABLES, m): projections in slots."""
        return (np.einsum("nd,tmd->ntm", x, self.a) + self.b) / WIDTH

    def of_points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.largest
        rest = np.sqrt(np.maximum(0, 1 - np.square(x).sum(axis=1)))
        return self.places(np.column_stack([x, rest]))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return self.places(np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]))

    def codes(self, slots: np.ndarray) -> np.ndarray:
        """Slots along the last axis as one number: BITS each, about 0."""
        half = 1 << (BITS - 1)
        s = np.clip(slots, -half, half - 1).astype(np.int64) + half
        return (s << (BITS * np.arange(s.shape[-1]))).sum(axis=-1)

    def distance(self, norm: float, product: float) -> float:
        return math.sqrt(min(4.0, max(2 - 2 * product / (norm * self.largest), 1e-12)))


_erf = np.vectorize(math.erf, otypes=[float])


def probes(place: np.ndarray, r: float, success: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, success) of the buckets around a query's place in a table in falling order of success, until they sum to it or are `most`."""
    base = np.floor(place)
    reach = int(math.ceil(4.5 * r / WIDTH)) + 1
    steps = np.arange(-reach, reach + 1)
    edge = 0.5 * (1 + _erf((steps[None, :] - (place - base)[:, None]) * (WIDTH / r / math.sqrt(2))))
    p = np.diff(edge, axis=1)  # slot by slot, as steps[:-1]
    top = p.max(axis=1)
    after = np.append(np.cumprod(top[::-1])[::-1][1:], 1.0)
    least = float(top.prod()) * (0.5 if most is None else 0.05)
    while True:
        chance, slots = np.ones(1), np.zeros((1, 0), np.int64)
        for i in range(len(p)):
            some = np.flatnonzero(p[i] > 0)
            grown = chance[:, None] * p[i, some][None, :]
            row, col = np.nonzero(grown * after[i] >= least)
            chance, slots = grown[row, col], np.column_stack([slots[row], steps[some[col]]])
        if chance.sum() >= success or (most is not None and len(chance) >= most) or least < 1e-12:
            break
        least /= 6
    order = np.argsort(-chance, kind="stable")
    enough = int(np.searchsorted(np.cumsum(chance[order]), success)) + 1
    order = order[: enough if most is None else min(enough, most)]
    return base.astype(np.int64) + slots[order], chance[order]


def _vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows take part, and their vectors in double precision."""
    ok, out = [], []
    for v in column:
        x = v.values if v.is_valid else None
        good = x is not None and len(x) > 0 and x.null_count == 0
        if good:
            x = x.to_numpy().astype(np.float64)
            good = bool(np.isfinite(x).all()) and bool(x.any())
        ok.append(good)
        if good:
            out.append(x)
    return np.array(ok, bool), out


def _valid(vectors: DataFrame, is_query: Column, key: str, vector: str) -> DataFrame:
    """id, asked, dim, norm, x (bytes of doubles): one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, xs = _vectors(b.column(2))
            keep = b.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [keep.column(0), keep.column(1), pa.array([len(x) for x in xs], pa.int32()), pa.array([float(np.linalg.norm(x)) for x in xs], pa.float64()), pa.array([x.tobytes() for x in xs], pa.binary())],
                names=["id", "asked", "dim", "norm", "x"],
            )

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.col(vector).alias("_v")).where("id IS NOT NULL AND _v IS NOT NULL")
    rows = rows.mapInArrow(run, "id long, asked boolean, dim int, norm double, x binary")
    return rows.groupBy("id").agg(F.max("asked").alias("asked"), F.min(F.struct("x", "dim", "norm")).alias("v")).select("id", "asked", "v.dim", "v.norm", "v.x")


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, matrix) of a batch with columns dim and x."""
    dims = b.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, np.frombuffer(b"".join(b.column("x").take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), d)


class Cells:
    """Where buckets lie: one of `count` cells by hash, or several by hash of the id for the buckets of more rows than a cell."""

    def __init__(self, count: int, large: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.count, self.large = count, large

    def parts(self, dim: int, bucket: np.ndarray) -> np.ndarray:
        keys, parts = self.large.get(dim, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        if not len(keys):
            return np.ones(len(bucket), np.int64)
        at = np.minimum(np.searchsorted(keys, bucket), len(keys) - 1)
        return np.where(keys[at] == bucket, parts[at], 1)

    def of(self, dim: int, bucket: np.ndarray, part: np.ndarray) -> np.ndarray:
        h = K.mix(bucket.astype(np.uint64) * K.MULT + np.uint64(dim))
        return (K.mix(h + part.astype(np.uint64)) % np.uint64(self.count)).astype(np.int64)


def _buckets(b: pa.RecordBatch, families: dict[int, Family]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, their buckets in each table) of a batch of points."""
    for d, at, x in _by_dim(b):
        f = families[d]
        yield d, at, f.codes(np.floor(f.of_points(x))) * TABLES + np.arange(TABLES)


def _large(points: DataFrame, families: Broadcast, rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dim the buckets to deal to several cells, sorted, and to how many: at most LARGE of them, a larger table having larger cells."""
    most = max(CELL_ROWS, -(-TABLES * rows // LARGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, _, bucket in _buckets(b, families.value):
                keys, n = np.unique(bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(keys), pa.int32()), pa.array(keys), pa.array(n)], names=["dim", "bucket", "n"])

    counted = points.select("dim", "x").mapInArrow(run, "dim int, bucket long, n long").groupBy("dim", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    out = {}
    for r in counted.orderBy("dim", "bucket").collect():
        keys, parts = out.setdefault(r["dim"], ([], []))
        keys.append(r["bucket"])
        parts.append(-(-r["n"] // most))
    return {d: (np.array(k), np.array(p)) for d, (k, p) in out.items()}


def _dealt(points: DataFrame, families: Broadcast, cells: Broadcast) -> DataFrame:
    """(cell, dim, bucket, id, x) of every point in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            for d, at, bucket in _buckets(b, families.value):
                salt = K.mix(ids[at].astype(np.uint64) * K.MULT)
                for t in range(TABLES):
                    parts = cells.value.parts(d, bucket[:, t])
                    cell = cells.value.of(d, bucket[:, t], (salt % parts.astype(np.uint64)).astype(np.int64))
                    rows = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), rows.column("dim"), pa.array(bucket[:, t]), rows.column("id"), rows.column("x")], names=["cell", "dim", "bucket", "id", "x"])

    return points.select("id", "dim", "x").mapInArrow(run, "cell long, dim int, bucket long, id long, x binary")


_ASKED = "cell long, id long, dim int, x binary, least double, buckets array<long>"


def _probed(queries: DataFrame, families: Broadcast, cells: Broadcast, success: float, most: int | None) -> DataFrame:
    """(cell, id, dim, x, least, buckets): where each query looks, a row for a cell."""
    each = 1 - (1 - success) ** (1 / TABLES)

    def looks(f: Family, d: int, places: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        bucket = np.concatenate([f.codes(probes(places[t], r, each, most)[0]) * TABLES + t for t in range(TABLES)])
        parts = cells.value.parts(d, bucket)
        many = np.repeat(bucket, parts)
        return cells.value.of(d, many, np.arange(len(many)) - np.repeat(np.cumsum(parts) - parts, parts)), many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least, norm = b.column("least").to_numpy(zero_copy_only=False), b.column("norm").to_numpy()
            for d, at, x in _by_dim(b):
                f = families.value[d]
                places = f.of_queries(x)
                for y in range(0, len(at), _STEP // 16):
                    found = [(i, *looks(f, d, row, f.distance(norm[i], least[i]))) for i, row in zip(at[y : y + _STEP // 16].tolist(), places[y : y + _STEP // 16], strict=True)]
                    who, cell, bucket = np.concatenate([np.full(len(c), i) for i, c, _ in found]), np.concatenate([c for _, c, _ in found]), np.concatenate([k for _, _, k in found])
                    order = np.lexsort((bucket, cell, who))
                    who, cell, bucket = who[order], cell[order], bucket[order]
                    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (cell[1:] != cell[:-1])]))
                    rows = b.take(pa.array(who[first]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(who)), pa.int32()), pa.array(bucket))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[first]), *(rows.column(c) for c in ("id", "dim", "x", "least")), lists], names=["cell", "id", "dim", "x", "least", "buckets"])

    return queries.mapInArrow(run, _ASKED)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    s = np.zeros(len(q))
    for j in range(q.shape[1]):
        s += q[:, j] * x[:, j]
    return s


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The entries that are among the k best of their query."""
    order = np.lexsort((ids, -score, q))
    start = np.searchsorted(q[order], q[order])
    return order[np.arange(len(order)) - start < k]


def _compared(k: int):
    """What the queries of a cell find there."""

    def of_dim(points: pa.Table, asked: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(points.column("x").to_pylist()), np.float64).reshape(-1, d)
        ids, bucket = points.column("id").to_numpy(), points.column("bucket").to_numpy()
        # Of equal vectors in a bucket the k + 1 of smallest id.
        _, alike = np.unique(x.view(np.dtype((np.void, x.itemsize * d))).ravel(), return_inverse=True)
        order = np.lexsort((ids, alike, bucket))
        b, a = bucket[order], alike[order]
        new = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (a[1:] != a[:-1])]))
        order = order[np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order)))) <= k]
        x, ids, bucket = x[order], ids[order], bucket[order]
        known, first = np.unique(bucket, return_index=True)
        ends = np.append(first[1:], len(bucket))
        q = np.frombuffer(b"".join(asked.column("x").to_pylist()), np.float64).reshape(-1, d)
        own, least = asked.column("id").to_numpy(), asked.column("least").to_numpy()
        lists = asked.column("buckets").combine_chunks()
        size = lists.value_lengths().fill_null(0).to_numpy()
        sought, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), size)
        at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
        hit = known[at] == sought
        every = np.flatnonzero(lists.is_null().to_numpy(zero_copy_only=False))
        at, who = np.concatenate([at[hit], np.tile(np.arange(len(known)), len(every))]), np.concatenate([who[hit], np.repeat(every, len(known))])
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cut = np.searchsorted(at, np.arange(len(known) + 1))
        slack = 1e-9 * np.linalg.norm(q, axis=1) * float(np.linalg.norm(x, axis=1).max(initial=0))
        for i in range(len(known)):
            rows = slice(first[i], ends[i])
            for y in range(cut[i], cut[i + 1], _STEP):
                some = who[y : min(y + _STEP, cut[i + 1])]
                product = q[some] @ x[rows].T
                n, m = np.nonzero((product >= (least - slack)[some][:, None]) & (own[some][:, None] != ids[rows][None, :]))
                score = _exact(q[some[n]], x[rows][m])
                keep = _best(some[n], ids[rows][m], score, k)
                found.append((some[n][keep], ids[rows][m][keep], score[keep]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        n, m, score = (np.concatenate(c) for c in zip(*found, strict=True))
        # One pair may come from two tables.
        once = np.unique(np.column_stack([n, m]), axis=0, return_index=True)[1]
        n, m, score = n[once], m[once], score[once]
        keep = _best(n, m, score, k)
        return own[n[keep]], m[keep], score[keep]

    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if points.num_rows and asked.num_rows:
            for d in np.intersect1d(points.column("dim").to_numpy(), asked.column("dim").to_numpy()).tolist():
                mine = lambda t: t.filter(pc.equal(t.column("dim"), d))  # noqa: B023, E731
                out.append(of_dim(mine(points), mine(asked), d))
        q, i, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def _searched(dealt: DataFrame, asked: DataFrame, blocks: int, k: int) -> DataFrame:
    """query_id, id, score: each query's k best of each cell that it looks into."""
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    if blocks > 1:  # a cell goes once to each block that looks into it
        asked = written(asked, "neighbour-probes")
        looked = asked.select(F.col("cell").alias("_cell"), F.col("block").alias("_block")).distinct()
        dealt = dealt.join(looked, F.col("cell") == F.col("_cell")).drop("_cell").withColumnRenamed("_block", "block")
    else:
        dealt = dealt.withColumn("block", F.lit(0))
    return dealt.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInArrow(_compared(k), "query_id long, id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounded(queries: DataFrame, points: DataFrame, families: dict[int, Family], k: int) -> DataFrame:
    """queries with column least: the 2 k-th best inner product in a sample of the points of the same length, -infinity if there are fewer."""
    spark = queries.sparkSession
    samples = {}
    for d in families:
        rows = max(2 * k + 1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d * len(families))))
        got = points.where(F.col("dim") == d).orderBy(F.xxhash64("id")).limit(rows).select("id", "x").collect()
        samples[d] = (np.array([r["id"] for r in got]), np.frombuffer(b"".join(r["x"] for r in got), np.float64).reshape(-1, d))
    sent = spark.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = np.full(b.num_rows, -np.inf)
            own = b.column("id").to_numpy()
            for d, at, x in _by_dim(b):
                ids, s = sent.value[d]
                for y in range(0, len(at), _STEP):
                    product = x[y : y + _STEP] @ s.T
                    product[own[at[y : y + _STEP]][:, None] == ids[None, :]] = -np.inf
                    if len(ids) >= 2 * k:
                        least[at[y : y + _STEP]] = np.partition(product, len(ids) - 2 * k, axis=1)[:, len(ids) - 2 * k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "dim", "norm", "x")), pa.array(least)], names=["id", "dim", "norm", "x", "least"])

    return queries.select("id", "dim", "norm", "x").mapInArrow(run, "id long, dim int, norm double, x binary, least double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", success: float = SUCCESS) -> DataFrame:
    """query_id, rank, key, score: for each vector that is_query the k others of largest inner product that are found."""
    spark = vectors.sparkSession
    points = written(_valid(vectors, is_query, key, vector), "neighbour-points")
    sizes = points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("m")).collect()  # a row for each length of vectors
    families = {r["dim"]: Family(r["dim"], r["n"], r["m"]) for r in sizes}
    sent = spark.sparkContext.broadcast(families)
    rows = sum(r["n"] for r in sizes)
    cells = spark.sparkContext.broadcast(Cells(max(2 * cores(spark), -(-TABLES * rows // CELL_ROWS)), _large(points, sent, rows)))
    asked = points.where("asked").repartition(max(cores(spark), rows // CELL_ROWS), "id")
    queries = written(_bounded(asked, points, families, k), "neighbour-queries")
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    dealt = written(_dealt(points, sent, cells), "neighbour-cells")
    search = lambda asked: written(_top(_searched(dealt, asked, blocks, k), k), "neighbour-found")
    first = search(_probed(queries, sent, cells, success, FIRST))
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    nearer = written(queries.join(kth, "id", "left").withColumn("least", F.greatest("least", F.coalesce("kth", F.lit(float("-inf"))))).drop("kth"), "neighbour-queries")
    found = written(_top(first.drop("rank").unionByName(search(_probed(nearer, sent, cells, success, None)).drop("rank")), k), "neighbour-found")
    # What has fewer neighbours than there are looks everywhere.
    wanted = F.least(F.lit(k), F.element_at(F.create_map(*[F.lit(v) for r in sizes for v in (r["dim"], r["n"] - 1)]), F.col("dim"))) if sizes else F.lit(0)
    have = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("have"))
    short = written(queries.join(have, "id", "left").where(F.coalesce("have", F.lit(0)) < wanted).select("id", "dim", "norm", "x", F.lit(float("-inf")).alias("least")), "neighbour-short")
    if not short.isEmpty():
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells.value.count - 1).cast("long")))
        everywhere = short.select(every.alias("cell"), "id", "dim", "x", "least", F.lit(None).cast("array<long>").alias("buckets"))
        found = _top(found.drop("rank").unionByName(search(everywhere).drop("rank")), k)
    return found.select("query_id", "rank", F.col("id").alias(key), "score")
