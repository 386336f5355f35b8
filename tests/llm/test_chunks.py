"""The table of chunks: kept from task to task, and new chunks of many blocks encoded at once."""

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import bpe
from assayer.llm import kernels as K
from assayer.llm.queries import vocabulary_path

TEXTS = [f"Word{i % 70} shared <|endoftext|> café́ x{i} Σς{i % 9}\n" * (1 + i % 3) for i in range(300)] + ["", "alone"]


@pytest.fixture()
def enc():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return bpe.Encoder(f.read())


def ids(enc, texts):
    out = []
    for flat, counts in bpe.packed_ids(enc.chunks(), K.buffers(pa.array(texts))):
        out += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    return out


def counted(enc, monkeypatch):
    calls, own = [], enc.automaton.encode_words
    monkeypatch.setattr(enc.automaton, "encode_words", lambda words: calls.append(len(words)) or own(words))
    return calls


def test_what_one_task_encoded_the_next_finds(enc, monkeypatch):
    first = ids(enc, TEXTS)
    calls = counted(enc, monkeypatch)
    assert ids(enc, TEXTS) == first
    assert sum(calls) == 0


def test_new_chunks_of_many_blocks_are_encoded_at_once(enc, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(vocabulary_path())
    lib.no_padding(), lib.no_truncation()
    monkeypatch.setattr(K.blocks, "__defaults__", (200,))
    plain = [t.replace("<|endoftext|>", "end") for t in TEXTS]
    blocks = len(list(K.blocks(K.buffers(pa.array(plain)))))
    calls = counted(enc, monkeypatch)
    assert ids(enc, plain) == [lib.encode(t, add_special_tokens=False).ids for t in plain]
    assert len(calls) <= -(-blocks // bpe.TOGETHER) < blocks // 4
    assert ids(enc, TEXTS) == [lib.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_a_full_table_is_forgotten_without_a_change_of_ids(enc, monkeypatch):
    whole = ids(enc, TEXTS)
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 20)
    assert [ids(enc, TEXTS[i : i + 7]) for i in range(0, 70, 7)] == [whole[i : i + 7] for i in range(0, 70, 7)]
