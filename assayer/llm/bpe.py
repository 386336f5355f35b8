"""BPE encoding and decoding by a deterministic automaton over the vocabulary.

The automaton starts with one state and a loop for every base symbol. Each
merge (a, b) in order of rank adds a gadget: the arc b is taken from the state
that a leads to; where a and then b could be read there is now an arc ab, and
the state it leads to has the arcs that b's had. After the last merge the
automaton accepts exactly the token sequences that the merges produce, so a
word's tokens are the labels of its one accepted path, found by table look-ups
from left to right; decoding emits the labels. All arcs with one label lead to
one state, so a state is named by its label, and a gadget is kept as its rank
and its two labels. Arcs are laid down in the table when a word first asks for
them, by following an arc back through the gadgets that copied it.

Defined results: null counts as empty and has no tokens; equal texts get equal
rows; texts of any length are encoded whole; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from assayer.llm import kernels as K

#: A worker forgets its encoded words and chunks when it holds so many; it bounds memory, not results.
CACHED_WORDS, CACHED_CHUNKS = 300_000, 1_000_000
#: Blocks of texts whose new chunks are encoded at once.
TOGETHER = 8
#: Words of more bytes are read one by one.
LONG = 256
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 upward."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        """vocab: token to id; end: the suffix of a word's last symbol ('' for none)."""
        self.end, self.labels = end, {i: t for t, i in vocab.items()}
        count = max(self.labels) + 1
        self._left, self._right, self._born = [-1] * count, [-1] * count, [-1] * count
        self._removed: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            ia, ib, iab = vocab[a], vocab[b], vocab[a + b]
            if self._born[iab] >= 0 or not self._has(ia, ib):
                continue  # nothing reads a and then b any more
            self._removed[ia << 16 | ib] = rank
            self._left[iab], self._right[iab], self._born[iab] = ia, ib, rank
        self._byte = {ord(c): b for b, c in enumerate(byte_symbols())}
        base = set(byte_symbols())
        base |= {c + end for c in base}
        self._trie: dict = {}
        for token, i in vocab.items():
            if self._born[i] < 0 and token not in base:
                continue
            node = self._trie
            for c in self._symbols(token):
                node = node.setdefault(c, {})
            node[0] = i
        self.compile()

    def _symbols(self, token: str) -> str:
        """One character a symbol; a symbol with the end suffix is its character moved up."""
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + 0x1000)
        return token

    def _has(self, a: int, b: int) -> bool:
        """Has the state that label a leads to an arc b? Followed back to the arc it was copied from: it lasts until its own gadget removes it."""
        until, removed, born = _NEVER - 1, self._removed.get, self._born
        while removed(a << 16 | b, _NEVER) > until:
            if born[a] > born[b]:
                until, a = born[a] - 1, self._right[a]
            elif born[b] >= 0:
                until, b = born[b], self._left[b]
            else:
                return True
        return False

    def compile(self) -> None:
        """Lay the trie of labels and the known arcs out as flat tables."""
        nodes, child_keys, child_values, token = [self._trie], [], [], []
        for at, node in enumerate(nodes):
            token.append(node.get(0, -1))
            for c, below in node.items():
                if c != 0:
                    child_keys.append(at << 9 | self._code(c))
                    child_values.append(len(nodes))
                    nodes.append(below)
        self._token = np.array(token, np.int32)
        self._child = Table(18)
        self._child.add(np.array(child_keys, np.int64), np.array(child_values, np.int32))
        self._size = np.zeros(max(self.labels) + 1, np.int32)
        for i, t in self.labels.items():
            self._size[i] = len(self._symbols(t))
        self._known = Table(16)
        self._ranks = Table(17)
        self._ranks.add(np.array(list(self._removed), np.int64), np.array(list(self._removed.values()), np.int32))
        self._arrays = [np.array(v, np.int64) for v in (self._left, self._right, self._born)]
        self._steps: dict[int, int] | None = None

    def _have(self, keys: np.ndarray) -> np.ndarray:
        """What _has says of many (a << 16 | b) at once."""
        left, right, born = self._arrays
        out, live, a, b = np.ones(len(keys), bool), np.arange(len(keys)), keys >> 16, keys & 0xFFFF
        until = np.full(len(keys), _NEVER)
        while len(live):
            rank = self._ranks.get(a << 16 | b)
            gone = (rank >= 0) & (rank <= until)
            out[live[gone]] = False
            x, y = born[a], born[b]
            on = ~gone & ((x >= 0) | (y >= 0))
            live, a, b, x, y = live[on], a[on], b[on], x[on], y[on]
            of_a = x > y
            until = np.where(of_a, x - 1, y)
            a, b = np.where(of_a, right[a], a), np.where(of_a, b, left[b])
        return out

    def _code(self, symbol: str) -> int:
        c = ord(symbol)
        return self._byte[c] if c < 0x1000 else 256 + self._byte[c - 0x1000]

    def _arc(self, before: np.ndarray, label: np.ndarray) -> np.ndarray:
        """May each label be read after the label before it (-1: at the start, where all may)?"""
        keys = before.astype(np.int64) << 16 | label
        found = self._known.get(keys)
        new = (found < 0) & (before >= 0)
        if new.any():
            keys_new = np.unique(keys[new])
            self._known.add(keys_new, self._have(keys_new).astype(np.int32))
            found[new] = self._known.get(keys[new])
        return (found > 0) | (before < 0)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids (little-endian uint16) of pre-split words, many words at a time."""
        out: list = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        lo, end = np.searchsorted(sizes[order], [1, LONG + 1]).tolist()
        for i in order[end:].tolist():
            out[i] = self._encode_long(words[i])
        while lo < end:
            hi = min(end, lo + max(64, 600_000 // int(sizes[order[min(end - 1, lo + 20_000)]])))
            some = order[lo:hi].tolist()
            for i, ids in zip(some, self._encode([words[i] for i in some], sizes[order[lo:hi]]), strict=True):
                out[i] = ids
            lo = hi
        return out

    def _encode_long(self, word: bytes) -> bytes:
        """One word of any length: the same transitions, a few steps a byte and 8 bytes of memory."""
        if self._steps is None:
            held = self._child.keys >= 0
            self._steps = dict(zip(self._child.keys[held].tolist(), self._child.values[held].tolist(), strict=True))
        step, token, n, ends = self._steps.get, self._token.tolist(), len(word), 256 if self.end else 0
        known: dict[int, bool] = {}
        label = array("i", [-1]) * (n + 1)
        for i in range(n):
            here, node = label[i], 0
            if here < 0 and i:
                continue
            for j in range(i, n):
                node = step(node << 9 | (word[j] if j < n - 1 else word[j] + ends))
                if node is None:
                    break
                t = token[node]
                if t >= 0:
                    key = here << 16 | t
                    ok = here < 0 or known.get(key)
                    if ok is None:
                        ok = known[key] = self._has(here, t)
                    if ok:
                        label[j + 1] = t
        ids, at = [], n
        while at:
            ids.append(label[at])
            at -= int(self._size[label[at]])
        return np.array(ids[::-1], "<u2").tobytes()

    def _encode(self, words: list[bytes], sizes: np.ndarray) -> list[bytes]:
        n, width = len(words), int(sizes.max())
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        if self.end:
            flat[ends - 1] += 256
        symbols = np.zeros((width, n), np.int64)
        row = np.repeat(np.arange(n), sizes)
        symbols[np.arange(len(flat)) - np.repeat(ends - sizes, sizes), row] = flat
        label = np.full((width + 1, n), -1, np.int32)
        for i in range(width):
            rows = np.flatnonzero(((label[i] >= 0) if i else (sizes > 0)) & (sizes > i))
            here, node = label[i][rows], np.zeros(len(rows), np.int64)
            for j in range(i, width):
                node = self._child.get(node << 9 | symbols[j][rows]).astype(np.int64)
                keep = node >= 0
                rows, here, node = rows[keep], here[keep], node[keep]
                if not len(rows):
                    break
                t = self._token[node]
                ends_here = np.flatnonzero(t >= 0)
                if len(ends_here):
                    t, r = t[ends_here], rows[ends_here]
                    ok = self._arc(here[ends_here], t)
                    t, r = t[ok], r[ok]
                    label[j + 1][r] = t
                more = sizes[rows] > j + 1
                if not more.all():
                    rows, here, node = rows[more], here[more], node[more]
                    if not len(rows):
                        break
        steps, at, live = [], sizes.copy(), np.arange(n)
        while len(live):
            t = label[at[live], live]
            steps.append((live, t))
            at[live] -= self._size[t]
            live = live[at[live] > 0]
        who = np.concatenate([w for w, _ in steps[::-1]])
        ids = np.concatenate([t for _, t in steps[::-1]])[np.argsort(who, kind="stable")].astype("<u2").tobytes()
        cuts = (2 * np.cumsum(np.bincount(who, minlength=n))).tolist()
        return [ids[x:y] for x, y in zip([0, *cuts], cuts, strict=False)]


class Table:
    """Open addressing over 64-bit keys in numpy: values for arrays of keys, -1 where a key is absent."""

    def __init__(self, bits: int):
        self.bits, self.used = bits, 0
        self._clear()

    def _clear(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        held = self.keys[slot]
        off = np.flatnonzero((held != keys) & (held != -1))
        while len(off):
            slot[off] = (slot[off] + 1) & mask
            held = self.keys[slot[off]]
            off = off[(held != keys[off]) & (held != -1)]
        return self.values[slot]

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are not there yet; the table grows to stay at most half full."""
        self.used += len(keys)
        if self.used * 2 > 1 << self.bits:
            old = self.keys >= 0
            keys, values = np.concatenate([keys, self.keys[old]]), np.concatenate([values, self.values[old]])
            self.bits = max(self.bits + 1, int(self.used * 2).bit_length())
            self._clear()
        mask, slots = (1 << self.bits) - 1, self._slot(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            won = free & (self.keys[slots] == keys)
            self.values[slots[won]] = values[won]
            keys, values, slots = keys[~won], values[~won], (slots[~won] + 1) & mask


class Encoder:
    """Normalises, splits and encodes as the vocabulary file says (NFC, lower case, byte-level, word ends)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        steps = spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or spec["decoder"]:
            raise ValueError("this vocabulary file's steps are not the ones built here")
        self._words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}") + "|\n").findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.labels = {**self.automaton.labels, **{i: t for t, i in self.special.items()}}
        if max(self.labels) >= 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self._seen: dict[str, bytes] = {"\n": b""}
        self._chunks: ChunkTable | None = None

    def chunks(self) -> ChunkTable:
        """The table of chunks of this process: what one task encoded, the next finds there."""
        if self._chunks is None:
            self._chunks = ChunkTable(self)
        return self._chunks

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        """The ids (little-endian uint16) of each run of text without ASCII white space; texts split there encode alike."""
        packed, sizes = self.encode_together(chunks)
        ends = np.cumsum(sizes).tolist()
        return [packed[x:y] for x, y in zip([0, *ends], ends, strict=False)]

    def encode_together(self, chunks: list[bytes]) -> tuple[bytes, np.ndarray]:
        """The ids of all chunks one after the other, and how many bytes each has."""
        marked = [i for i, c in enumerate(chunks) if b"<|" in c] if b"<|" in b"\n".join(chunks) else []
        if not marked:
            return self._encode_plain(chunks)
        cut = []
        for x, y in zip([0, *(i + 1 for i in marked)], [*marked, len(chunks)], strict=True):
            packed, sizes = self._encode_plain(chunks[x:y])
            cut.append((packed, sizes))
            if y < len(chunks):
                one = self._with_special(chunks[y])
                cut.append((one, np.array([len(one)])))
        return b"".join(p for p, _ in cut), np.concatenate([n for _, n in cut])

    def _encode_plain(self, chunks: list[bytes]) -> tuple[bytes, np.ndarray]:
        """The ids of all chunks one after the other, and how many bytes each has; no chunk holds a special token."""
        text = b"\n".join(chunks).decode("utf-8", "replace")
        if not text.isascii():
            # Letter by letter: a capital sigma does not depend on its place in the word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        items = self._words(text.lower())
        distinct = set(items)
        new = list(distinct.difference(self._seen))
        if len(self._seen) + len(new) > CACHED_WORDS or max(map(len, new), default=0) > 4 * LONG:
            self._seen = {w: self._seen[w] for w in distinct.difference(new)} | {"\n": b""}
        self._seen.update(zip(new, self.automaton.encode_words([w.encode() for w in new]), strict=True))
        ids = list(map(self._seen.__getitem__, items))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        # A chunk's ids lie together; a line feed between two chunks has none, and a word has some.
        line = np.flatnonzero(size == 0)
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.append(total[line], total[-1])
        return b"".join(ids), np.diff(ends, prepend=0) if chunks else np.zeros(0, np.int64)

    def _with_special(self, chunk: bytes) -> bytes:
        out: list[bytes] = []
        for part in self._cut(chunk.decode("utf-8", "replace")):
            if part in self.special:
                out.append(self.special[part].to_bytes(2, "little"))
            elif part:
                out += self._plain(part)
        return b"".join(out)

    def _plain(self, text: str) -> list[bytes]:
        words = [w for w in self._words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()) if w != "\n"]
        return self.automaton.encode_words([w.encode() for w in words])

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The compiled automaton for every executor: its size is the vocabulary file's, read once on the driver."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(Encoder(f.read()))


class ChunkTable:
    """The ids of the chunks of text (runs without ASCII white space) met so far, by fingerprint; A-Z count as a-z, as they do in the ids."""

    def __init__(self, enc: Encoder):
        self.enc = enc
        self._clear()

    def _clear(self) -> None:
        self.table, self.ids, self.used = Table(16), np.zeros(1 << 16, "<u2"), 0
        self.start, self.size, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _add(self, keys: np.ndarray, packed: bytes, sizes: np.ndarray) -> None:
        n, more = len(keys), np.frombuffer(packed, "<u2")
        while self.count + n > len(self.start):
            self.start, self.size = (np.concatenate([v, np.zeros_like(v)]) for v in (self.start, self.size))
        while self.used + len(more) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(more)] = more
        self.start[self.count : self.count + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.count : self.count + n] = sizes
        self.table.add(keys, np.arange(self.count, self.count + n, dtype=np.int32))
        self.count, self.used = self.count + n, self.used + len(more)

    def _read(self, texts: K.Texts) -> tuple[np.ndarray, ...]:
        """The place of each chunk of a block (-1 if it is new), the number of chunks of each text, and of the new chunks
        where they lie in the block, their fingerprints, starts and ends."""
        s, e, counts = K.word_bounds(texts)
        keys = (K.hashes_of(texts, s, e) >> np.uint64(1)).view(np.int64)
        d = texts.data
        marks = np.flatnonzero((d[:-1] == ord("<")) & (d[1:] == ord("|")))
        for w in np.unique(np.searchsorted(s, marks, side="right") - 1).tolist():  # special tokens are told by case
            keys[w] = int.from_bytes(hashlib.blake2b(d[s[w] : e[w]].tobytes(), digest_size=8).digest(), "little") >> 1
        which = self.table.get(keys)
        new = np.flatnonzero(which < 0)
        return which, counts, new, keys[new], s[new], e[new]

    def encode(self, texts: list[K.Texts]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each block the ids of its texts one after the other, and how many each text has. What is new in all the
        blocks is encoded at once: the automaton's steps are the same few array operations for any number of words."""
        if self.count > CACHED_CHUNKS or self.used > 8 * CACHED_CHUNKS:
            self._clear()
        read = [self._read(t) for t in texts]
        keys, first = np.unique(np.concatenate([r[3] for r in read]), return_index=True)
        if len(keys):
            starts, ends = (np.concatenate([r[c] for r in read])[first].tolist() for c in (4, 5))
            block = np.repeat(np.arange(len(read)), [len(r[3]) for r in read])[first].tolist()
            raw_ = [t.data.tobytes() for t in texts]
            packed, sizes = self.enc.encode_together([raw_[i][x:y] for i, x, y in zip(block, starts, ends, strict=True)])
            self._add(keys, packed, sizes // 2)
        for which, counts, new, of_new, _, _ in read:
            which[new] = self.table.get(of_new)
            size = self.size[which]
            total = np.concatenate([[0], np.cumsum(size)])
            ends = np.cumsum(counts)
            yield self.ids[K.ranges(self.start[which], size)], total[ends] - total[ends - counts]


def packed_ids(cache: ChunkTable, texts: K.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of texts their ids one after the other (uint16), and how many each has."""
    blocks = list(K.blocks(texts))
    for i in range(0, len(blocks), TOGETHER):
        yield from cache.encode(blocks[i : i + TOGETHER])


def runs(texts: list[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lists of texts of about size bytes together."""
    run, total = [], 0
    for t in texts:
        run.append(t)
        total += len(t)
        if total >= size:
            yield run
            run, total = [], 0
    if run:
        yield run


def raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>: the tokens of each whole text."""
    vocab = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = vocab.value.chunks()
        for b in batches:
            at = 0
            for ids, counts in packed_ids(cache, K.buffers(b.column(1))):
                rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype("i4")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(counts)), rows], names=[key, "ids"])
                at += len(counts)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, decoded: the labels of each row's ids, joined as the vocabulary's library does."""
    vocab = vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocab.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, "decoded"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, decoded string")


class Phrases:
    """Strings by id, laid end to end with a blank before each, to write out many ids at a time."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(b" " + x for x in strings), np.uint8)
        self.size = np.array([len(x) + 1 for x in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """The strings of each text's ids, joined by a blank."""
        size = self.size[ids]
        text = self.data[K.ranges(self.start[ids], size)].tobytes()
        total, ends = np.concatenate([[0], np.cumsum(size)]), np.cumsum(counts)
        for x, y in zip(total[ends - counts].tolist(), total[ends].tolist(), strict=True):
            yield text[x + 1 : y]


def token_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: both directions in one pass over the texts."""
    vocab = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocab.value
        cache, n = enc.chunks(), max(enc.labels) + 1
        decimal, decoded = Phrases([b"%d" % i for i in range(n)]), Phrases([enc.labels.get(i, "").encode() for i in range(n)])
        digest = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
        for b in batches:
            at = 0
            for ids, counts in packed_ids(cache, K.buffers(b.column(1))):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(counts)), pa.array(counts, pa.int64()), digest(decimal.join(ids, counts)), digest(decoded.join(ids, counts))],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(counts)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
