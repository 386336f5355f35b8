"""The work and the memory of a search in a shard follow what its queries can gain."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import kernels as K
from assayer.llm import top_k as search

DOCS, QUERIES, BEST = 1024, 64, 10


class Counted(np.ndarray):
    """Counts the scores that products with it make."""

    made = 0

    def __array_ufunc__(self, ufunc, method, *inputs, **kw):
        plain = [np.asarray(x) if isinstance(x, Counted) else x for x in inputs]
        out = getattr(ufunc, method)(*plain, **kw)
        if ufunc is np.matmul:
            Counted.made += out.size
        return out


@pytest.fixture
def asked():
    """A shard of two languages, as many documents of each, and a batch of queries of both by turns."""
    rng = np.random.default_rng(7)
    texts = [9 * f"{'ab'[i % 2]} " + " ".join(f"{'ab'[i % 2]}{w}" for w in rng.integers(0, 40, 30)) for i in range(DOCS)]
    row = search._build("doc_id")(pa.table({"doc_id": np.arange(DOCS), "_text": texts, "_shard": np.zeros(DOCS, np.int64)}))
    codes, _, counts, _ = search._terms(K.buffers(pa.array(texts[:QUERIES])))
    terms = np.unique(codes)
    return {c: np.frombuffer(row.column(c)[0].as_py(), kind) for c, kind in search._FIELDS.items()}, terms, np.searchsorted(terms, codes), counts


def test_blocks_are_scored_for_the_queries_that_can_gain(asked):
    row, terms, place, counts = asked
    shard = search.Shard(row, terms, np.ones(len(terms)), 30.0)
    none = shard.search(place, counts, np.zeros(QUERIES), BEST)
    least = np.full(QUERIES, np.inf)
    np.minimum.at(least, none[0], none[2])
    shard.rows, Counted.made = shard.rows.view(Counted), 0
    again = shard.search(place, counts, least, BEST)
    assert all(np.array_equal(x, y) for x, y in zip(none, again, strict=True)) and len(none[0]) == QUERIES * BEST
    assert 0 < Counted.made <= 0.55 * QUERIES * DOCS


def test_memory_of_a_batch_does_not_follow_the_terms_of_all_queries(asked):
    row, terms, place, counts = asked
    more = np.unique(np.concatenate([terms, np.arange(1, 2_000_001, dtype=np.uint64)]))
    shard = search.Shard(row, more, np.ones(len(more)), 30.0)
    place = np.searchsorted(more, terms)[place]
    tracemalloc.start()
    shard.search(place, counts, np.zeros(QUERIES), BEST)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
