"""Removal of repeated passages by content-defined chunks of lines.

A text is read as lines; a line of several sentences is read as its sentences, so that a passage wrapped into one line has lines too. A rolling
hash over the hashes of two neighbouring lines chooses the boundaries, so equal passages get equal chunks wherever they stand. Lines of
several sentences and lines of `LONG_WORDS` words and more stand apart from their neighbours, and only chunks of at least two lines (or one
such long line) and `CHUNK_WORDS` words are looked at.

Chunks alone would miss a passage that no whole chunk falls into, so from each line on the shortest run of neighbouring lines with `RUN_WORDS` words
(two lines at least, or `LONG_WORDS` words in one) is looked at too, across all boundaries: every repeated passage of so many words holds such
runs, and those from its first line to its end cover it.

Chunks whose hash occurs again anywhere in the corpus are compared byte by byte, runs by 128-bit BLAKE2 digests (their bodies would move every line
of a copy several times). The first occurrence (smallest id, then place) stays, all others
go, together with the lines next to them that equal (by their 64-bit hashes) those next to the first occurrence: that covers the edges of a
passage, whose boundaries depend on its neighbours. What goes must be a run of at least `RUN_WORDS` words.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.collocations import Filter, make_filter
from chalkline.llm.common import rows_of, small_side, stage, text_of

LONG_WORDS = 40
CHUNK_WORDS = 8
RUN_WORDS = 20
MARGIN = 6
EVERY = 2  # a boundary after one in so many lines, once two are gathered; a power of two
TEXTS = 256  # looked at together
POWER = 0x9FB21C651E98DF25
ROW = "_line_row"
CUT = "_line_cut"


def units_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """(lines, line of the text each stands in, size of the block each begins or 0). Blank lines are none."""
    units: list[str] = []
    places: list[int] = []
    blocks: list[int] = []
    open_at = -1  # where the running block of short lines began
    for n, line in enumerate(text.split("\n")):
        if not line or line.isspace():
            continue
        parts = [line] if "\0" in line else line.replace(". ", ".\0").replace("? ", "?\0").replace("! ", "!\0").split("\0")
        if len(parts) > 1 or line.count(" ") + 1 >= LONG_WORDS:
            open_at = -1
            blocks += [len(parts), *[0] * (len(parts) - 1)]
        elif open_at < 0:
            open_at = len(units)
            blocks.append(1)
        else:
            blocks[open_at] += 1
            blocks.append(0)
        units += parts
        places += [n] * len(parts)
    return units, places, blocks


def _spans(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the line ranges a to b by the hashes of their lines, wherever they stand. They only choose what is looked at closely."""
    powers, back = (np.cumprod(np.append(np.uint64(1), np.full(len(h), x, np.uint64))) for x in (POWER, pow(POWER, -1, 1 << 64)))
    sums = np.append(np.uint64(0), np.cumsum(h * powers[:-1]))
    x = (sums[b] - sums[a]) * back[a]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Items:
    """The chunks and then the runs of texts that are looked at: lines `a` to `b` of all lines `units`, with a hash and the text `doc` they stand in."""

    def __init__(self, texts: list[str]):
        self.units: list[str] = []
        blocks: list[int] = []
        self.ends = [0]  # of the texts, from the second place on
        for text in texts:
            units, _, sizes = units_of(text)
            self.units += units
            blocks += sizes
            self.ends.append(len(self.units))
        n = len(self.units)
        self.lines = h = np.fromiter(map(xxhash.xxh64_intdigest, self.units), np.uint64, n)
        words = np.fromiter((u.count(" ") + 1 for u in self.units), np.int64, n)
        total = np.append(0, np.cumsum(words))
        ends = np.array(self.ends)
        doc = np.repeat(np.arange(len(texts)), np.diff(ends))

        sizes = np.array(blocks, np.int64)
        heads = np.flatnonzero(sizes)
        head, tail = np.repeat(heads, sizes[heads]), np.repeat(heads + sizes[heads], sizes[heads])
        place = np.arange(n)
        pair = np.append(np.uint64(1 << 17), h[:-1] * np.uint64(31) + h[1:])[:n] >> np.uint64(17)
        maybe = np.flatnonzero((pair % np.uint64(EVERY) == 0) & (place > head) & (place < tail - 1))
        cuts, start = [], -1
        for i, first in zip(maybe.tolist(), head[maybe].tolist()):
            if i > max(start, first):
                start = i + 1
                cuts.append(start)
        a = np.sort(np.append(heads, np.array(cuts, np.int64)))
        b = np.append(a[1:], n)[:len(a)]
        fits = (total[b] - total[a] >= CHUNK_WORDS) & ((b - a > 1) | (words[a] >= LONG_WORDS))
        a, b = a[fits], b[fits]
        self.chunks = len(a)

        stop = np.minimum(np.searchsorted(total, total[:-1] + LONG_WORDS), np.maximum(np.searchsorted(total, total[:-1] + RUN_WORDS), place + 2))
        runs = np.flatnonzero(stop <= ends[1:][doc])
        self.a, self.b = np.append(a, runs), np.append(b, stop[runs])
        self.doc = doc[self.a]
        self.hash = _spans(h, self.a, self.b)
        self.hash[self.chunks:] ^= np.uint64(POWER)

    def near(self, places: np.ndarray, sizes: np.ndarray, step: int) -> pa.ListArray:
        """The hashes of so many lines from each place on, forwards or backwards."""
        offsets = np.append(0, np.cumsum(sizes))
        at = np.repeat(places, sizes) + step * (np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.lines[at].view(np.int64)))

    def columns(self, kept: np.ndarray) -> dict[str, pa.Array]:
        """Of the items `kept`, in order: place in the text, hash, a digest in two halves (chunks: another hash and zero), body of chunks, hashes of the lines before
        and after them, nearest first."""
        a, b = self.a[kept], self.b[kept]
        texts = ["\n".join(self.units[i:j]) for i, j in zip(a.tolist(), b.tolist())]
        n = int(np.searchsorted(kept, self.chunks))
        bodies = texts[:n] + [None] * (len(texts) - n)
        digests = b"".join(hashlib.blake2b(t.encode("utf-8"), digest_size=16).digest() for t in texts[n:])
        check, rest = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2).T
        check = np.append(np.fromiter((xxhash.xxh64_intdigest(t, 1) for t in texts[:n]), np.uint64, n).view(np.int64), check)
        rest = np.append(np.zeros(n, np.int64), rest)
        doc, ends = self.doc[kept], np.array(self.ends)
        begin, end = ends[:-1][doc], ends[1:][doc]
        margin = np.where(kept < self.chunks, MARGIN, 0)
        return {"start": pa.array(a - begin, pa.int32()), "stop": pa.array(b - begin, pa.int32()), "hash": pa.array(self.hash[kept].view(np.int64)),
                "check": pa.array(check), "rest": pa.array(rest), "body": pa.array(bodies, pa.string()),
                "before": self.near(a - 1, np.minimum(margin, a - begin), -1), "after": self.near(b, np.minimum(margin, end - b), 1)}


def chunks_of(text: str) -> list[tuple]:
    """(start, end, hash, check, rest, body, before, after) of the chunks and runs of one text."""
    items = Items([text])
    return list(zip(*(c.to_pylist() for c in items.columns(np.arange(len(items.a))).values())))


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the lines in `cuts` (start, end), as far as they make runs of RUN_WORDS words."""
    units, places, _ = units_of(text)
    gone = bytearray(len(units))
    for a, b in cuts:
        for i in range(max(a, 0), min(b, len(units))):
            gone[i] = 1
    i = 0
    while i < len(units):
        if gone[i]:
            j = i
            while j < len(units) and gone[j]:
                j += 1
            if sum(u.count(" ") + 1 for u in units[i:j]) < RUN_WORDS:
                gone[i:j] = bytes(j - i)
            i = j
        else:
            i += 1
    if not any(gone):
        return text
    kept: dict[int, list[str]] = {}
    touched = set()
    for u, place, g in zip(units, places, gone):
        if g:
            touched.add(place)
        else:
            kept.setdefault(place, []).append(u)
    out = []
    for n, line in enumerate(text.split("\n")):
        if n not in touched:
            out.append(line)
        elif n in kept:
            out.append(" ".join(kept[n]))
    result = "\n".join(out)
    return "" if result.isspace() else result


def _same_prefix(a: str, b: str) -> Column:
    """Number of leading elements in which two arrays agree."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(first == 0, F.size(a)).otherwise(first - 1).cast("int")


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts of a row that overlap or touch become one."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("cuts"))
        row = np.repeat(np.arange(len(lists)) << 32, pc.list_value_length(lists).to_numpy())
        start, stop = (row + x.to_numpy() for x in lists.flatten().flatten())
        order = np.argsort(start, kind="stable")
        start, reach = start[order], np.maximum.accumulate(stop[order])
        heads = np.flatnonzero(np.append(True, start[1:] > reach[:-1])[:len(start)])
        ends = np.append(heads[1:], len(start))[:len(heads)] - 1
        offsets = np.searchsorted(start[heads], np.arange(len(lists) + 1) << 32)
        cuts = pa.StructArray.from_arrays([pa.array(x & 0xFFFFFFFF, pa.int32()) for x in (start[heads], reach[ends])], names=["start", "stop"])
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cuts)], names=["row", "cuts"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, cuts): the line ranges to remove, apart from each other, for each row that has any, by a hash of its id and text."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                items = Items(batch.column(2).slice(start, TEXTS).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(items.hash.view(np.int64))], names=["hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                row, key, body = (c.slice(start, TEXTS) for c in batch.columns)
                items = Items(body.to_pylist())
                hits = np.flatnonzero(known.has(items.hash))
                for some in np.array_split(hits, len(hits) // 20_000 + 1):
                    doc = pa.array(items.doc[some])
                    columns = {"row": row.take(doc), "id": key.take(doc), **items.columns(some)}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    source = docs.select(_row(id_col, text_col).alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    kind = dict(source.dtypes)["id"]
    again = source.mapInArrow(hashes, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    # The filter is of bounded size; what it lets through besides is counted out below.
    shared = docs.sparkSession.sparkContext.broadcast(make_filter(stage(again, "again")))
    fields = f"row long, id {kind}, start int, stop int, hash long, check long, rest long, body string, before array<long>, after array<long>"
    seen = stage(source.mapInArrow(run, fields), "seen")
    shared.unpersist()
    # Bytes are compared by the least and the greatest body; what is joined back is found by two hashes, which tell the bodies apart (where they
    # do not, nothing is cut).
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row", "start", "stop", "before", "after")
    first = seen.groupBy("hash", "check", "rest").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min("body").alias("least"), F.max("body").alias("most"))
    first = stage(first.where("n > 1 and least <=> most").select("hash", "check", "rest", "first"), "first")
    both = seen.drop("body").join(first, ["hash", "check", "rest"]).where("not (row = first.row and start < first.stop)")
    both = both.select("row", "start", "stop", "before", "after", F.col("first.before").alias("first_before"), F.col("first.after").alias("first_after"))
    cuts = both.select("row", F.struct((F.col("start") - _same_prefix("before", "first_before")).alias("start"),
                                       (F.col("stop") + _same_prefix("after", "first_after")).alias("stop")).alias("cut"))
    return cuts.groupBy("row").agg(F.collect_list("cut").alias("cuts")).mapInArrow(_merged, "row long, cuts array<struct<start int, stop int>>")


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with repeated passages cut from the texts (and `length_col`, where it exists, set to the new length); all rows stay.

    Null and empty texts stay as they are. Rows equal in id and text count as one document and keep the same lines; null ids come after all
    others where the first occurrence is chosen. A text that is cut as a whole becomes empty.
    """
    marked = docs.withColumn(ROW, _row(id_col, text_col))
    cuts = stage(repeated_lines(docs, id_col, text_col).select(F.col("row").alias(ROW), F.col("cuts").alias(CUT)), "cuts")
    cuts = small_side(cuts, F.sum(2 * F.size(CUT) + 2))
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = [], []
            for text, cut in rows_of([batch], text_col, CUT):
                new = text if text is None or not cut else without(text, [(c["start"], c["stop"]) for c in cut])
                texts.append(new)
                lengths.append(None if new is None else len(new))
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if length_col in names:
                k = names.index(length_col)
                changed = [new if cut else old for new, old, cut in zip(lengths, columns[k].to_pylist(), batch.column(len(names)).to_pylist())]
                columns[k] = pa.array(changed, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = marked.join(cuts, ROW, "left").select(*[F.col(f"`{c}`") for c in names], CUT)
    return joined.mapInArrow(run, docs.schema)
