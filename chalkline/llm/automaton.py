"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton reads token labels; its state is the token last read, and it accepts exactly the token sequences that the merges produce. It is
built gadget by gadget in merge order. The gadget of the merge (u, v) -> w does nothing if state u has no arc v at this time (u and v never
meet, or are never made); otherwise it

* adds the state w, whose row is the row that v has at this time (what may follow w is what may follow v then),
* adds the arc w to every state that has the arc u at this time (after the cut below, which matters where u = v),
* cuts the arc v from state u (u and v side by side have become w).

With 49,000 labels the full table has two thousand million entries, nearly all never met, so a gadget is kept as its three numbers and a table
entry is filled from the gadgets when it is first met: undo the younger of state and label until both are single symbols, and see whether a
gadget older than what was undone cut the arc on the way. Encoding a word runs the automaton over all labels that spell its prefixes (a trie):
exactly one accepted sequence spells any prefix, so each place of the word is entered once. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import rows_of, text_of
from chalkline.llm.vocabulary import Vocabulary, byte_symbols, special_pattern, splitter

#: Split of the lower-case word vocabulary (fixed value of its file format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TABLE_ROWS = 100_000
CACHE_BYTES = 64 << 20  # a worker's, both generations
ENTRY_BYTES = 190  # of a key, a value and their place in the table, beside their characters
START = -1
_CONTROL = dict.fromkeys(range(0x1C, 0x20))  # Python splits words there, Unicode white space does not


@dataclass
class Automaton:
    labels: list[str]
    left: list[int]  # of the gadget of a label; -1: single symbol
    right: list[int]
    rank: list[int]
    cut: dict[tuple[int, int], int]  # (state, label) -> rank of the gadget that cuts the arc
    arcs: list[dict[str, int]]  # trie of the labels without suffix
    inner: list[int]  # label that ends at a trie node inside a word
    final: list[int]  # label that ends at a trie node and the word
    table: dict[int, bool] = field(default_factory=dict)

    def step(self, state: int, label: int) -> bool:
        """Does `state` have an arc `label`?"""
        key = state << 20 | label
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= TABLE_ROWS:
                self.table.clear()
            known = self.table[key] = self.arc(state, label, len(self.labels))
        return known

    def arc(self, state: int, label: int, limit: int) -> bool:
        """Had `state` an arc `label` when the gadgets below rank `limit` were in place?"""
        rank = self.rank
        while True:
            k = self.cut.get((state, label))
            if k is not None and k < limit:
                return False
            a, b = rank[state], rank[label]
            if a < 0 and b < 0:
                return True
            if b >= a:
                label, limit = self.left[label], b + 1
            else:
                state, limit = self.right[state], a

    def encode(self, word: str) -> list[int]:
        """Labels of the one accepted path that spells the word's symbols.

        Longer labels are tried first. A place that no path leads on from is never tried again: only one accepted path leads to a place,
        so whatever was tried from there was all there is.
        """
        n, arcs, inner, final, known, step = len(word), self.arcs, self.inner, self.final, self.table.get, self.step
        path: list[int] = []
        places: list[int] = []
        choices: list[list[int]] = []
        dead = bytearray(n + 1)
        at, state, found = 0, START, None
        while at < n:
            if found is None:  # ends and labels in turn
                found, node, j = [], 0, at
                while j < n:
                    node = arcs[node].get(word[j])
                    if node is None:
                        break
                    j += 1
                    label = inner[node] if j < n else final[node]
                    if label >= 0:
                        found += (j, label)
            while found:
                label, end = found.pop(), found.pop()
                if dead[end]:
                    continue
                if state < 0:
                    break
                ok = known(state << 20 | label)
                if ok is None:
                    ok = step(state, label)
                if ok:
                    break
            else:
                dead[at] = 1
                at, found = places.pop(), choices.pop()
                path.pop()
                state = path[-1] if path else START
                continue
            places.append(at)
            choices.append(found)
            path.append(label)
            at, state, found = end, label, None
        return path

    def decode(self, path: list[int]) -> str:
        """The labels of the arcs, with single spaces between them (the vocabulary declares no decoder)."""
        return " ".join([self.labels[k] for k in path])


def compile_merges(vocab: Vocabulary) -> Automaton:
    """The automaton of a vocabulary whose merges only join symbols and results of earlier merges."""
    size = max([*vocab.ids.values(), *vocab.special.values()]) + 1
    labels = [""] * size
    for s, k in [*vocab.ids.items(), *vocab.special.items()]:
        labels[k] = s
    left, right, rank, cut = [-1] * size, [-1] * size, [-1] * size, {}
    for n, (a, b) in enumerate(vocab.merges):
        u, v, w = vocab.ids[a], vocab.ids[b], vocab.ids[a + b]
        if max(rank[u], rank[v]) >= n or rank[w] >= 0:
            raise ValueError(f"merge {n} is out of order")
        left[w], right[w], rank[w], cut[u, v] = u, v, n, n
    auto = Automaton(labels, left, right, rank, cut, [{}], [-1], [-1])
    void: set[int] = set()
    for a, b in vocab.merges:
        w = vocab.ids[a + b]
        if left[w] in void or right[w] in void or not auto.arc(left[w], right[w], rank[w]):
            void.add(w)
    singles = set(byte_symbols())
    for s, k in vocab.ids.items():
        ends = vocab.suffix and s.endswith(vocab.suffix)
        body = s[: -len(vocab.suffix)] if ends else s
        if k in void or rank[k] < 0 and body not in singles:
            continue
        node = 0
        for c in body:
            nxt = auto.arcs[node].get(c)
            if nxt is None:
                nxt = auto.arcs[node][c] = len(auto.arcs)
                auto.arcs.append({})
                auto.inner.append(-1)
                auto.final.append(-1)
            node = nxt
        if ends or not vocab.suffix:
            auto.final[node] = k
        if not ends:
            auto.inner[node] = k
    return auto


class WordCodec(dict):
    """Ids of text chunks between white space, as little-endian 32-bit bytes: the one cache of a worker, bounded by its bytes.

    Two generations: what is met goes into the young one (this dict); when that is full it becomes the old one, and what is met there again moves up.
    A word inside a chunk is looked up as the chunk that it would be alone; one beyond ASCII, which as a chunk would be normalised once more, is kept
    under a space and the word (no chunk holds a space).
    """

    def __init__(self, auto: Automaton, special: dict[str, int]):
        super().__init__()
        self.auto, self.special = auto, special
        self.old: dict[str, bytes] = {}
        self.room = CACHE_BYTES // 2
        self.words, self.wide, self.cuts, self.symbols = splitter(WORDS), splitter(r"\S+"), special_pattern(special), byte_symbols()

    def __reduce__(self):
        return WordCodec, (self.auto, self.special)

    def keep(self, key: str, code: bytes) -> bytes:
        if len(key) <= 64:
            self.room -= len(key) + len(code) + ENTRY_BYTES
            if self.room < 0:
                self.old = dict(self)
                self.clear()
                self.room = CACHE_BYTES // 2
            self[key] = code
        return code

    def __missing__(self, key: str) -> bytes:
        code = self.old.get(key)
        if code is None:
            code = self.word(key[1:]) if key[0] == " " else self.chunk(key)
        return self.keep(key, code)

    def word(self, word: str) -> bytes:
        path = self.auto.encode("".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]))
        return b"".join([k.to_bytes(4, "little") for k in path])

    def chunk(self, chunk: str) -> bytes:
        out: list[bytes] = []
        for k, part in enumerate(self.cuts.split(chunk) if self.cuts else [chunk]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            plain = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            words = self.words.findall(plain)
            if words == [chunk]:  # kept as the chunk already
                out.append(self.word(chunk))
            else:
                out += [self[word] if word.isascii() else self[" " + word] for word in words]
        return b"".join(out)

    def chunks(self, text: str) -> list[str]:
        """Nothing the encoding joins spans white space."""
        if any(chr(c) in text for c in _CONTROL):
            return self.wide.findall(text)
        return text.split()

    def code(self, text: str) -> tuple[bytes, str]:
        """(ids, decoded text) of a whole text."""
        ids = b"".join([self[c] for c in self.chunks(text)])
        return ids, self.auto.decode(np.frombuffer(ids, "<u4").tolist())


def _broadcast(docs: DataFrame, vocab: Vocabulary):
    """The codec for the workers: its size is bounded by the vocabulary, and its tables fill over all tasks of a worker process."""
    return docs.sparkSession.sparkContext.broadcast(WordCodec(compile_merges(vocab), vocab.special))


def encode_documents(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of each row: token ids as an array of ints and the text that decoding them gives.

    Null texts count as empty and give no ids and an empty text; repeated rows are kept; null ids stay null.
    """
    shared = _broadcast(docs, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                codes = [codec.code(t[0]) for t in rows_of([part], "body")]
                sizes = pa.array([0, *[len(c[0]) // 4 for c in codes]], pa.int32())
                offsets = pa.array(sizes.to_numpy().cumsum(), pa.int32())
                flat = pa.Array.from_buffers(pa.int32(), offsets[-1].as_py(), [None, pa.py_buffer(b"".join([c[0] for c in codes]))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array([c[1] for c in codes], pa.string())],
                                                 names=["id", "ids", "decoded"])

    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what `encode_documents` gives, made beside the encoding."""
    shared = _broadcast(docs, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            rows = []
            for (text,) in rows_of([batch], "body"):
                ids, decoded = codec.code(text)
                rows.append((len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded.encode("utf-8")).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
