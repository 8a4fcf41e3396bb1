"""Token counts by heap-and-linked-list byte-pair merging, with no identifiers emitted.

A pre-token's symbols stand in a linked list; a heap holds its adjacent pairs by merge rank and place. The lowest pair is popped again and
again; a pair that an earlier merge has changed is skipped. The count is the number of symbols at first minus the merges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import rows_of, text_of
from chalkline.llm.vocabulary import SPACE, Vocabulary, byte_symbols, special_pattern, splitter

#: Split of the byte-level vocabulary (fixed value of its file format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ROWS = 400_000

PLACE = 1 << 40


class Merges:
    """Merge ranks by pair of symbols, and the symbol each merge gives."""

    def __init__(self, vocab: Vocabulary):
        ids = vocab.ids
        self.bytes = [ids[s] for s in byte_symbols()]
        self.ranks = {ids[a] << 24 | ids[b]: n for n, (a, b) in enumerate(vocab.merges)}
        self.results = [ids[a + b] for a, b in vocab.merges]

    def length(self, data: bytes) -> int:
        """Number of symbols that are left of the bytes when no pair can be merged."""
        n = len(data)
        if n < 2:
            return n
        symbols, get = [self.bytes[b] for b in data], self.ranks.get
        heap = [r * PLACE + i for i in range(n - 1) if (r := get(symbols[i] << 24 | symbols[i + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            rank, i = divmod(heappop(heap), PLACE)
            j = after[i]
            if symbols[i] < 0 or j >= n or get(symbols[i] << 24 | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = self.results[rank], -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := get(symbols[i] << 24 | symbols[k])) is not None:
                    heappush(heap, r * PLACE + i)
            h = before[i]
            if h >= 0 and (r := get(symbols[h] << 24 | symbols[i])) is not None:
                heappush(heap, r * PLACE + h)
        return left


class Counter(dict):
    """Counts of text pieces; a piece is what stands between two spaces, and is counted with the space before it."""

    def __init__(self, merges: Merges, special: dict[str, int]):
        super().__init__()
        self.merges, self.special = merges, special
        self.known: dict[str, int] = {}  # counts of single pre-tokens
        self.cuts, self.split = special_pattern(special), splitter(PIECES)
        self.units = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.mixed = re.compile(f"[{SPACE}] (?:[{SPACE}]|$)|  ")

    def __reduce__(self):
        return Counter, (self.merges, self.special)

    def __missing__(self, piece: str) -> int:
        n = self.plain(" " + piece)
        if len(self) >= CACHE_ROWS:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n

    def plain(self, text: str) -> int:
        total = 0
        for t in self.split.findall(text):
            n = self.known.get(t)
            if n is None:
                n = self.merges.length(t.encode("utf-8", "surrogatepass"))
                if len(self.known) >= CACHE_ROWS:
                    self.known.clear()
                if len(t) <= 64:
                    self.known[t] = n
            total += n
        return total

    def section(self, text: str) -> int:
        """Tokens of a text without special strings. A run of white space is only split before its last character, so a text falls into
        independent pieces at spaces, unless a space stands within a run: there the pieces are a run and the word after it."""
        if not text:
            return 0
        if self.mixed.search(text):
            return sum(self[u[1:]] if u[0] == " " else self.plain(u) for u in self.units.findall(text))
        first, *pieces = text.split(" ")
        return (self.plain(first) if first else 0) + sum([self[p] for p in pieces])

    def count(self, text: str) -> int:
        """Tokens of a whole text; special strings in it count one each."""
        parts = self.cuts.split(text) if self.cuts else [text]
        return sum(1 if k % 2 else self.section(p) for k, p in enumerate(parts))


def count_tokens(docs: DataFrame, vocab: Vocabulary, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row's whole text.

    Null texts count as empty (0 bytes, 0 tokens); repeated rows are kept; null ids stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Counter(Merges(vocab), vocab.special))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for batch in batches:
            counts = [counter.count(t[0]) for t in rows_of([batch], "body")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"))
    counted = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
